"""Personal data: fixed base patterns, and candidates scored by boosted trees.

Base spans (email, ip, card, phone) are matched and checked by rule and always
stay.  High-recall generators propose further, overlapping spans; gradient-
boosted trees over format and context features score them; those at or above a
calibrated threshold that meet no base span are added, the better one where two
overlap.  Everything on the main path is a built-in function on the row: the
trees become one SQL expression, and a document never leaves its partition.

The trees are trained here, on a bounded set of synthetic examples made by
``examples`` from a fixed seed; a held-out part of them sets the threshold.

Defined cases: a null or empty text has no span; repeated rows are each
searched, texts of any length whole; offsets count code points; of equal scores
the span that begins first counts, then the longer; an empty table gives no row.
The result has the columns of the table, ``base_spans`` and ``all_spans``, which
take the place of columns of such a name; a table's other columns keep their
values, whatever their names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed patterns.  Runs are possessive and begin where a run begins, so that
#: long runs are searched in linear time; \G lets a match begin where the last one ended.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*BASE, "id", "secret"]
#: (kind, pattern, substring without which there is no match).  Mail addresses and secrets have any length; numbers
#: are as long as their formats allow: 15 digits of a telephone number, 34 characters of an account number.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?| dot )[A-Za-z]{2,}+)++", None),
    ("phone", r"(?<![A-Za-z0-9+])(?:00[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-]{1,2}[0-9]{2,5}){2,6}(?![A-Za-z0-9])", None),
    ("phone", r"(?<![0-9+])(?:\+|00)[0-9]{8,15}(?![0-9])", None),
    ("id", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "-"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])", None),
)
SPAN = "array<struct<kind:string,start:int,end:int,body:string>>"


def spans_of(text: Column, kind: str, pattern: str, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches with code-point offsets.

    Lengths of what lies between matches and of the matches themselves add up
    to the offsets.
    """
    lit = lambda s: F.lit(s)
    hits = F.regexp_extract_all(text, lit(pattern), lit(0))
    both = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    walk = lambda s: F.aggregate(
        F.sequence(F.lit(0), F.size(s["hits"]) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, i: F.struct(
            (a["at"] + F.length(s["gaps"][i]) + F.length(s["hits"][i])).alias("at"),
            F.concat(a["out"], F.array(F.struct(lit(kind).alias("kind"), (a["at"] + F.length(s["gaps"][i])).alias("start"), (a["at"] + F.length(s["gaps"][i]) + F.length(s["hits"][i])).alias("end"), s["hits"][i].alias("body")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    found = F.transform(F.array(both), lambda s: F.when(F.size(s["hits"]) > 0, walk(s)))[0]
    there = F.regexp_like(text, lit(pattern)) if needs is None else F.contains(text, lit(needs)) & F.regexp_like(text, lit(pattern))
    return F.when(there, F.coalesce(found, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """From the right, every second digit doubled, less 9 where that is over 9; the sum ends in 0."""
    ds = F.transform(F.split(F.reverse(_digits(s)), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    added = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(added, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).substr(1, 4).cast("int") <= 255))
    if kind == "card":
        return luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["body"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the matches that pass; a failing match is dropped and not tried again."""
    needs = {"email": "@", "ip": ".", "phone": "+"}
    return {k: F.filter(spans_of(text, k, p, needs.get(k)), _check(k)) for k, p in BASE.items()}


#: Words before a candidate that speak for or against it, in the supported languages.
FOR = r"(?i)(?:token|secret|passw|pwd|api|key|auth|bearer|credential|phone|tel|call|mobil|cell|fax|mail|contact|ssn|social|iban|account|konto|compte|cuenta|whatsapp|teléfono|téléphone)[^A-Za-z0-9]{0,6}[A-Za-z_]{0,12}[^A-Za-z0-9]{0,6}$"
AGAINST = r"(?i)(?:isbn|issn|doi|order|invoice|version|build|page|pages|date|year|since|score|price|total|figure|table|chapter|part|model|serial|commit|sha|md5|uuid|http|www|look|arrive|meet|stay)[^A-Za-z0-9]{0,4}[A-Za-z]{0,8}[^A-Za-z0-9]{0,4}[A-Za-z0-9./-]{0,8}$"


def features(c: Column, text: Column) -> list[Column]:
    """Format and context of a candidate struct (kind, start, end, body, generator)."""
    s = c["body"]
    n = F.length(s)
    digits = F.length(_digits(s))
    upper = n - F.length(F.regexp_replace(s, "[A-Z]", ""))
    before = F.substring(text, F.greatest(c["start"] - 31, F.lit(1)), F.least(c["start"], F.lit(32)))
    one = lambda b: b.cast("double")
    return [
        c["generator"].cast("double"),
        n.cast("double"),
        digits / n,
        digits.cast("double"),
        upper / n,
        F.size(F.array_distinct(F.split(s, ""))) / n,
        F.size(F.array_distinct(F.split(s, ""))).cast("double"),
        F.size(F.split(s, "[ .()-]+")).cast("double"),
        one(F.regexp_like(s, F.lit("^[0-9a-f]+$|^[0-9A-F]+$"))),
        one(F.regexp_like(s, F.lit(r"\(at\)|\[at\]|\{at\}|dot\b"))),
        one(F.regexp_like(s, F.lit(r"^[12][0-9]{3}[ .-]|[ .-][12][0-9]{3}$"))),
        (n - F.length(F.regexp_replace(s, "[-_/=+]", ""))) / n,
        one(F.regexp_like(s, F.lit("[0-9][A-Za-z]+[0-9]"))),
        one(F.regexp_like(before, F.lit(FOR))),
        one(F.regexp_like(before, F.lit(AGAINST))),
        one(F.regexp_like(before, F.lit("[=:]\\s*[\"']?$"))),
        one(F.regexp_like(s, F.lit(r"^[0-9]{1,3}(?:[ .][0-9]{3})+$"))),
        one(F.regexp_like(s, F.lit(r"^(?:0|\(0)"))),
        one(F.regexp_like(s, F.lit(r"^\("))),
        # Groups of one length, as in lists of numbers and years.
        one(F.size(F.array_distinct(F.transform(F.split(s, "[ .()-]+"), lambda g: F.length(g)))) == 1),
        one(F.regexp_like(s, F.lit(r"^[A-Z]{2}[0-9]{2}"))),
        # Letters that follow each other, as in words.
        F.array_max(F.transform(F.split(s, "[^A-Za-z]+"), lambda g: F.length(g))) / n,
        F.size(F.split(s, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")).cast("double"),
        one(F.regexp_like(s, F.lit("/"))),
    ]


def _named(generator: int):
    return lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), F.lit(generator).alias("generator"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def candidates(text: Column) -> Column:
    """All generators' spans: (kind, start, end, body, generator)."""
    made = []
    for g, (kind, pattern, needs) in enumerate(GENERATORS):
        made.append(F.transform(spans_of(text, kind, pattern, needs), _named(g)))
    # A long run of letters alone is a word, and a separator alone is no content.
    return F.filter(F.concat(*made), lambda x: (x["kind"] != "secret") | (F.regexp_like(x["body"], F.lit("[0-9]")) & F.regexp_like(x["body"], F.lit("[A-Za-z]"))))


def examples(n: int = 3000, seed: int = 20_240_101) -> list[tuple[str, int, int, int]]:
    """Synthetic (text, start, end, is personal), ``n`` of them, the same on every run."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "an", "er", "in", "ou", "le", "que", "sch", "ei", "ca", "do", "st"]) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 2)) + d(1) + "k"
    sep = lambda: r.choice(" -.")
    lead = lambda *known: r.choice([*known, words(1, 3) + " ", words(2, 4) + " "])

    def mail():
        a = r.choice([" at ", "(at)", "[at]", "{at}", " (at) ", " [at] ", " {at} ", "(at) ", " (at)"])
        o = r.choice([".", ".", "(dot)", "[dot]", " (dot) ", " [dot] ", " {dot} "]) if a != " at " else " dot "
        host = word() + r.choice(["", "-" + word()])
        return lead("", "mail ", "contact: ", "address "), f"{word()}{r.choice(['', '.', '_', d(1)])}{r.choice(['', word()])}{a}{host}{o}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'io', 'it'])}"

    def phone():
        s = sep()
        forms = [f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{r.randint(2, 9)}{d(2)}{s}{d(3)}{s}{d(4)}", f"0{d(2)}{s}{d(3)}{s}{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0049 {d(3)} {d(4)} {d(3)}"]
        forms += [f"+{d(11)}", f"00{d(11)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(4)} {d(3)}", f"{r.choice('679')}{d(2)} {d(3)} {d(3)}", f"{r.choice('89')}{d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}"]
        return lead("call ", "phone: ", "tel ", "tel. ", "mobile ", "fax ", "whatsapp ", "number is "), r.choice(forms)

    def account():
        country = r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "AT", "CH"])
        body = "".join(r.choice("0123456789" if r.random() < 0.85 else "ABCDEFGHMNWX0123456789") for _ in range(r.choice([14, 16, 18, 20, 23])))
        plain = country + d(2) + body
        return lead("IBAN ", "iban: ", "IBAN: ", "account ", "konto "), r.choice([plain, " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))])

    def positive():
        k = r.random()
        if k < 0.25:
            return mail()
        if k < 0.5:
            return phone()
        if k < 0.58:
            return lead("ssn ", "SSN: ", "social security "), f"{d(3)}-{d(2)}-{d(4)}"
        if k < 0.7:
            return account()
        before = lead('token = "', "secret: ", "api_key=", "password: ", 'key = "', "Bearer ", "auth token ", "TOKEN=", "secret=")
        return before, r.choice([hexes(r.choice([32, 36, 40, 48, 64])), mixed(r.randint(20, 48)), "sk_live_" + mixed(24), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "eyJ" + mixed(30)])

    def listed():
        start, step, k = r.choice([r.randint(10, 99), 100 * r.randint(1, 9), r.randint(1900, 2020)]), r.choice([1, 1, 2, 5, 10, 100]), r.randint(3, 5)
        return r.choice([" ", "-", "."]).join(str(start + i * step) for i in range(k))

    def negative():
        return r.choice(
            [
                lambda: (lead("on ", "date ", "since "), f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
                lambda: (lead("on "), f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}"),
                lambda: (lead("total ", "price "), f"{r.randint(10, 99)} {d(3)} {d(3)}"),
                lambda: ("ISBN ", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"),
                lambda: (lead("order ", "invoice ", "part "), f"{d(4)}-{d(4)}-{d(2)}"),
                lambda: (lead("version ", "build "), f"{d(2)}.{d(2)}.{d(2)}"),
                lambda: (lead(), f"{d(2)} {d(2)} {d(2)} {d(2)}"),
                lambda: (lead(), listed()),
                lambda: (lead(), " ".join(f"{r.randint(1, 49):02d}" for _ in range(6))),
                lambda: (lead("from "), f"{d(2)}.{d(2)}-{d(2)}.{d(2)}"),
                lambda: (lead(), f"{word()} at {word()}. {word().capitalize()}"),
                lambda: (lead(), f"look at {word()} dot {word()}"),
                lambda: (lead(), f"{word()} at {word()} dot {word()}{word()}{word()}"),
                lambda: (lead(), "-".join(word() for _ in range(6)) + f"-{d(1)}"),
                lambda: ("http://" + word() + "/", "/".join(word() for _ in range(5)) + f"/{d(4)}/x"),
                lambda: (lead("doi 10."), f"{d(4)}/{word()}{d(3)}/{word()}{word()}{d(2)}"),
                lambda: (lead("path /"), "/".join(word() + r.choice(["", d(1)]) for _ in range(6)) + f"/v{d(1)}"),
                lambda: (lead("uuid "), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"),
                lambda: (lead(), "_".join(word() for _ in range(5)) + d(2)),
                lambda: (lead(), "=" * 20 + d(1) + "x"),
                lambda: (lead(), word() * 5 + d(2)),
                lambda: (lead(), "".join(word() for _ in range(8)).capitalize() + d(1)),
            ]
        )()

    rows = []
    for i in range(n):
        good = i % 2
        before, body = positive() if good else negative()
        head = f"{words(2, 6)}. {before}" if r.random() < 0.8 else before
        rows.append((head + body + r.choice(['"', ".", ",", ""]) + " " + words(1, 5), len(head), len(head) + len(body), good))
    return rows


def _tree_sql(node, name) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction())) + "D"
    split = node.split()
    return f"CASE WHEN {name(split.featureIndex())} <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild(), name)} ELSE {_tree_sql(node.rightChild(), name)} END"


_FITTED: dict[int, tuple[list, float]] = {}


def fitted(spark: SparkSession, n: int = 3000) -> tuple[list[tuple[float, str]], float]:
    """(weight, SQL over an array ``f``) of each tree, and the threshold of their weighted sum.

    The threshold is the lowest at which 99 of 100 accepted held-out examples
    are personal.  Kept for the process: it depends on the examples alone.
    """
    if n not in _FITTED:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        rows = spark.createDataFrame([(i, *x) for i, x in enumerate(examples(n))], "i int, text string, a int, z int, label double".replace("label double", "good int")).coalesce(1)
        found = rows.withColumn("c", F.explode(candidates(F.col("text"))))
        hit = F.least(F.col("z"), F.col("c.end")) - F.greatest(F.col("a"), F.col("c.start"))
        found = found.filter(hit > 0).withColumn("label", ((F.col("good") == 1) & (2 * hit >= F.col("z") - F.col("a"))).cast("double"))
        data = found.select("i", "label", array_to_vector(F.array(*features(F.col("c"), F.col("text")))).alias("features")).cache()
        model = GBTClassifier(maxIter=16, maxDepth=4, stepSize=0.3, seed=7).fit(data.filter("i % 5 <> 0"))
        trees = [(float(w), _tree_sql(t._java_obj.rootNode(), lambda k: f"f[{k}]")) for w, t in zip(model.treeWeights, model.trees)]
        held = sorted(((r["rawPrediction"][1], r["label"]) for r in model.transform(data.filter("i % 5 = 0")).select("rawPrediction", "label").collect()), reverse=True)  # bounded: a fifth of n examples
        data.unpersist()
        threshold, good = float("inf"), 0
        for k, (raw, label) in enumerate(held, 1):
            good += label
            if good >= 0.99 * k:
                threshold = raw
        _FITTED[n] = trees, max(float(threshold), 0.0)
    return _FITTED[n]


def find(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (kind, start, end, body), by kind and start."""
    trees, threshold = fitted(spark)
    # The table's own columns stay apart from those that are worked with.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    df = rows.withColumns({f"_{k}": v for k, v in base_spans(text).items()}).withColumn("_base", F.concat(*[f"_{k}" for k in BASE])).withColumn("_found", candidates(text))
    total = " + ".join(f"{w!r}D * ({sql})" for w, sql in trees)
    scored = F.transform("_found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["body"].alias("body"), F.array(*features(c, text)).alias("f")))
    df = df.withColumn("_scored", F.when(F.size("_found") > 0, scored))
    # A raw sum of r is a probability of 1 / (1 + exp(-2 r)).
    df = df.withColumn("_scored", F.expr(f"transform(_scored, c -> struct(c.kind AS kind, c.start AS start, c.end AS end, c.body AS body, transform(array(c.f), f -> 2 * ({total}))[0] AS score))"))
    df = df.withColumn("_scored", F.expr(f"filter(_scored, c -> c.score >= {threshold!r}D AND NOT exists(_base, b -> b.start < c.end AND c.start < b.end))"))
    # Where two overlap, the better one stays; of equals, the one that begins first, then the longer.
    better = "(o.score > c.score OR (o.score = c.score AND (o.start < c.start OR (o.start = c.start AND (o.end > c.end OR (o.end = c.end AND o.kind < c.kind))))))"
    df = df.withColumn("_added", F.expr(f"filter(_scored, c -> NOT exists(_scored, o -> o.start < c.end AND c.start < o.end AND {better}))"))
    plain = F.coalesce(F.expr("transform(_added, c -> struct(c.kind AS kind, c.start AS start, c.end AS end, c.body AS body))"), F.array().cast(SPAN))
    both = F.concat("_base", plain)
    by_kind = F.concat(*[F.array_sort(F.filter(both, _of_kind(k)), lambda a, b: a["start"] - b["start"]) for k in KINDS])
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("base_spans", "all_spans")]
    return df.select(*own, F.col("_base").alias("base_spans"), by_kind.alias("all_spans"))


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, _of_kind(kind))).cast("long")


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets.

    Spans are taken from the left; what an earlier one covers is not replaced again.
    """
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    body = F.aggregate(
        order,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, body).otherwise(text)
