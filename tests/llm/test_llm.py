"""Operators against brute force on small tables with nulls, empty and repeated texts, ties and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cartolith.llm import bpe, classifier, fingerprints, html_text, jaccard_join, packing, pii, quality_rules, suffix_dedup, warc
from cartolith.llm.textbytes import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Random texts with near copies, exact copies, repeats, nulls and empty texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    out = [text(r.randint(1, 120)) for _ in range(n)]
    base = text(150)
    for i in range(25):
        w = base.split()
        for _ in range(i % 6):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    passage = text(60)
    out += [text(30) + "\n" + passage + "\n" + text(20) for _ in range(4)]
    out += [out[0], out[0], "", None, " \n ", "one", "One", "x y", "Ab " * 120, "a" * 450, text(20) + "\n" + text(20)]
    return [(i, t, "en", "s", 0) for i, t in enumerate(out)]


DOCS = "doc_id long, text string, lang string, source string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [rows[3], (None, "lonely text here", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def test_session_settings_come_back(spark):
    from cartolith.llm.common import BATCH_ROWS, small_batches

    before = spark.conf.get(BATCH_ROWS, None)
    with small_batches(spark):
        assert spark.conf.get(BATCH_ROWS) == "500"
    assert spark.conf.get(BATCH_ROWS, None) == before


def brute_components(rows, k, num, den):
    sets = []
    for _, t, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                up[find(i)] = find(j)
    best = {}
    big = 1 << 62
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), big), big if r[0] is None else r[0])
    return Counter((r[0], len(sets[i]), None if best[find(i)] == big else best[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,num,den,task", [(3, 90, 100, 3_000_000), (5, 8, 10, 3_000_000), (3, 7, 10, 900)])
def test_jaccard_components(spark, docs, k, num, den, task):
    df, rows = docs
    got = jaccard_join.jaccard_components(spark, df, k, num, den, task_shingles=task).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, k, num, den)


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    for n in (1, 5, 200, 256, 257, 3000):
        x = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
        y = np.unique(np.r_[x[: max(1, n - n // 9)], r.integers(0, 1 << 60, n // 12, dtype=np.uint64)])
        apart = len(np.setxor1d(x, y))
        for words in (1, 4):
            a, b = (jaccard_join.folded(jaccard_join.parities(s), words) for s in (x, y))
            assert np.bitwise_count(a ^ b).sum() <= apart
        c = len(x) + len(y) - apart
        if 20 * (c // 2) >= 16 * (len(x) + len(y) - c // 2):
            assert jaccard_join.may_link(jaccard_join.parities(x).tobytes(), jaccard_join.parities(y).tobytes(), len(x), len(y), 8, 10)


def test_members_of_a_region_are_joined():
    """The forest joins whatever the sketches allow, big sets with more bits, and nothing within a family."""
    r = np.random.default_rng(5)
    sets = []
    for n in (30, 400, 3000):
        base = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
        for k in range(12):
            s = base.copy() if k < 8 else np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
            s[: k * n // 100] = r.integers(0, 1 << 60, k * n // 100)
            sets.append(np.unique(s))
    n, sketches = np.array([len(s) for s in sets]), [jaccard_join.parities(s) for s in sets]
    for root in (np.arange(36), np.arange(36) // 4):
        got, want = jaccard_join.Union(36), jaccard_join.Union(36)
        edges = jaccard_join.linked_members(n, root, sketches, 9, 10)
        assert len(edges) < 36 and all(root[i] != root[j] for i, j in edges)
        for u in (got, want):
            for i in range(36):
                u.join(i, int(np.flatnonzero(root == root[i])[0]))
        for i, j in edges:
            got.join(i, j)
        for i in range(36):
            for j in range(i):
                if jaccard_join.may_link(sketches[i].tobytes(), sketches[j].tobytes(), n[i], n[j], 9, 10):
                    want.join(i, j)
        assert [got.find(i) for i in range(36)] == [want.find(i) for i in range(36)]
        assert len({want.find(i) for i in range(36)}) >= (12 if root[1] else 2)


def test_voronoi_join_is_exact():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 60, 80, dtype=np.uint64))
    sets = []
    for i in range(140):
        s = base.copy()
        for _ in range(int(r.integers(0, 14))):
            s[r.integers(0, len(s))] = r.integers(0, 1 << 60)
        sets.append(np.unique(s))
    a, b = jaccard_join.Union(140), jaccard_join.Union(140)
    seen = {"regions": 0, "split": 0, "windows": 0}
    jaccard_join.voronoi_join(sets, 9, 10, a, leaf=12, seen=seen)
    for i in range(140):
        for j in range(i):
            c = np.intersect1d(sets[i], sets[j]).size
            if 10 * c >= 9 * (len(sets[i]) + len(sets[j]) - c):
                b.join(i, j)
    assert [a.find(i) for i in range(140)] == [b.find(i) for i in range(140)]


def test_voronoi_join_uses_regions_and_windows():
    """Six groups with texts between some of them: many regions, windows that hold boundary sets, the links of brute force."""
    r = np.random.default_rng(1)
    bases = [np.unique(r.integers(0, 1 << 60, 120, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for i in range(300):
        s = bases[i % 6].copy()
        if i % 7 == 0:  # between two groups
            k = int(r.integers(2, 60))
            s[:k] = bases[(i + 1) % 6][:k]
        for _ in range(int(r.integers(0, 12))):
            s[r.integers(0, len(s))] = r.integers(0, 1 << 60)
        sets.append(np.unique(s))
    a, b, seen = jaccard_join.Union(300), jaccard_join.Union(300), {"regions": 0, "split": 0, "windows": 0}
    jaccard_join.voronoi_join(sets, 9, 10, a, leaf=80, seen=seen)
    jaccard_join.join_block(sets, np.arange(300), np.arange(300), 9, 10, b)
    assert [a.find(i) for i in range(300)] == [b.find(i) for i in range(300)]
    assert seen["regions"] >= 6 and seen["split"] >= 300 and seen["windows"] > 0


@pytest.mark.parametrize("small", [1, 4, 1000])
def test_jaccard_regions_of_all_sizes(spark, monkeypatch, small):
    """Common phrases in many unrelated texts: regions above and below the limit give the same groups."""
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", small)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdef") for _ in range(3))
    phrase = " ".join(word() for _ in range(9))
    rows = []
    for i in range(60):
        body = [word() for _ in range(r.randint(4, 60))]
        rows.append((2 * i, phrase + " " + " ".join(body)))
        body[r.randrange(len(body))] = word()
        rows.append((2 * i + 1, phrase + " " + " ".join(body)))
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 8, 10).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 3, 8, 10)


def test_jaccard_rows_that_share_identifiers(spark):
    """Null and repeated identifiers with different texts; columns with the operator's own names."""
    r = random.Random(13)
    texts = [" ".join(r.choice("abcdefgh") * 4 + str(r.randrange(90)) for _ in range(40)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0] + " x"), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3] + " x"), (7, texts[3]), (None, None), (None, "")]
    df = spark.createDataFrame([(*x, 1, "sid", 2.0) for x in rows], "doc_id long, text string, n int, sid string, text_key double")
    got = jaccard_join.jaccard_components(spark, df, 3, 8, 10, full=True).collect()
    group = {(x.doc_id, x.text_key.hex()): x.component for x in got}
    key = lambda i, t: (i, hashlib.md5((t or "").encode()).hexdigest())
    assert group[key(*rows[0])] == group[key(*rows[1])] and group[key(*rows[4])] == group[key(*rows[5])] == group[key(*rows[6])]
    assert len({group[key(*rows[i])] for i in (0, 2, 3, 4)}) == 4 and group[key(None, None)] is None
    assert {x.component_id for x in got if x.doc_id == 7} == {5}


def test_fingerprints(spark):
    rows = corpus()
    got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(spark, spark.createDataFrame(rows, DOCS), parts=4).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    order = sorted(text, reverse=True)
    for k, i in enumerate(order):
        nxt = text[order[(k + 1) % len(order)]]
        cut = len(text[i]) // 3
        want = text[i][: len(text[i]) - cut] + nxt[:cut]
        assert got[i].n_chars == len(text[i]) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        a, b = (set(s.tolist()) for s in shingles([text[i].encode(), want.encode()], 5))
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i].near_edited - true) < 0.2
    same = [got[i].fingerprint for i, t in text.items() if t == text[0]]
    assert len(set(same)) == 1 and got[order[0]].near_next is not None
    assert fingerprints.fingerprint_neighbours(spark, spark.createDataFrame([], DOCS)).count() == 0


def slow_codes(text, bins=fingerprints.BINS, bits=fingerprints.BITS):
    """One text's codes by plain loops: hash once, smallest hash a bin, empty bins by their own order, last bits."""
    found = shingles([text.encode()], 5)[0].tolist()
    if not found:
        return None
    held = {}
    for h in found:
        b = h >> (64 - (bins.bit_length() - 1))
        held[b] = min(h, held.get(b, h))
    order = fingerprints.bin_orders(bins)[0]
    codes = []
    for b in range(bins):
        source = b if b in held else next(int(x) for x in order[b] if int(x) in held)
        odd = int(fingerprints.splitmix(np.array([b + 123_457], np.uint64))[0]) | 1
        codes.append(((held[source] * odd) & (2**64 - 1)) >> (64 - bits))
    return codes


def slow_likeness(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_fingerprints_equal_plain_loops(spark):
    """Few and many filled bins, repeated and null identifiers, a table of one row, columns with the operator's names."""
    r = random.Random(41)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    base = text(90)
    rows = [(1, text(900)), (2, base), (3, base + " x"), (4, None), (5, " "), (6, "a b"), (7, text(68)), (8, text(40_000)), (None, text(20)), (2, text(30))]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, near_next double")
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), reverse=True)
    got = Counter((x.doc_id, x.n_chars, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in fingerprints.fingerprint_neighbours(spark, df, parts=3).collect())
    want = Counter()
    show = lambda c: "" if c is None else "".join(f"{x:x}" for x in c)
    for k, (_, t, i) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        own, new, near = slow_codes(t), slow_codes(t[: len(t) - cut] + following[:cut]), slow_codes(following)
        want[(i, len(t), show(own), show(new), round(slow_likeness(own, new), 9), round(slow_likeness(own, near), 9))] += 1
    assert got == want
    one = fingerprints.fingerprint_neighbours(spark, df.filter("doc_id = 1"), parts=3).first()
    assert one.near_next == 1.0 and one.edited_fingerprint != one.fingerprint


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1200
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (9, "u", big), (None, "u", "é" * 600), (6, "u", "é" * 600)]
    manifest, folder = warc.deduplicated_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.record_key: r for r in warc.resolve_revisits(warc.read_archives(manifest, folder, 2)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 6)}


def test_warc_headers(spark):
    """A revisit names the record, URI and date of its response; files begin with warcinfo; bodies of revisits aren't stored."""
    import gzip

    big = "y" * 1500
    rows = [(1, "http://a/1", big, 0), (7, "http://a/7", big, 0), (3, None, "é", 0), (4, "http://a/4", "z" * 3_000_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    manifest, folder = warc.deduplicated_archives(spark, df)
    records, first = {}, set()
    for m in manifest.collect():
        with gzip.open(m.path) as f:
            found = list(warc.parse_records(f))
        first.add(found[0][0]["warc-type"])
        assert found[0][0]["warc-filename"] == m.path.rsplit("/", 1)[1] and len(found) == m.records + 1
        records |= {int(h["x-record-key"]): (h, b) for h, b in found[1:]}
    assert first == {"warcinfo"} and set(records) == {1, 3, 4, 7}
    h, block = records[1]
    kept = records[7][0]
    assert h["warc-type"] == "revisit" and h["warc-refers-to"] == kept["warc-record-id"] and h["warc-refers-to-target-uri"] == "http://a/7" and h["warc-refers-to-date"] == kept["warc-date"] == h["warc-date"]
    assert block.endswith(b"\r\n\r\n") and big.encode() not in block and b"Content-Length: 1500" in block and "warc-target-uri" not in records[3][0]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"])
    empty, folder = warc.deduplicated_archives(spark, df.limit(0))
    assert warc.resolve_revisits(warc.read_archives(empty, folder, 2)).count() == 0


def brute_quality(t):
    w = WORD.findall(t or "")
    tri = list(zip(w, w[1:], w[2:]))
    c = Counter(tri)
    cov = {k + d for k, x in enumerate(tri) if c[x] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for x in w for ch in x), len(lines) - len(set(lines)), len(cov)


def test_quality_counts(spark, docs):
    df, rows = docs
    judged = quality_rules.quality_rules(df, quality_rules.language_references(df))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged.collect())
    assert got == Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert "source" in judged.columns and not any(c.startswith("_") for c in judged.columns)


@pytest.mark.parametrize("most", [quality_rules.LOOKED_UP, 3])
def test_quality_of_many_languages_and_long_words(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "LOOKED_UP", most)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = []
    for k, lang in enumerate(["aa", *(f"l{k:02d}" for k in range(70)), "zz"]):
        size = 12 if lang == "aa" else 5
        known = [word(size) for _ in range(30)]
        rows += [(2 * k, lang, " ".join(r.choice(known) for _ in range(2400))), (2 * k + 1, lang, " ".join(word(size) for _ in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = quality_rules.quality_rules(df, quality_rules.language_references(df)).collect()
    assert all(x.class_distance is not None and x.kept == (x.doc_id % 2 == 0) for x in got) and len(got) == len(rows)


def slow_distances(rows):
    """(class_distance, word_distance) of each row of (doc_id, text, lang, ...), by plain counting."""
    kinds = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", "[\x00-\x7f]", ".")]

    def classes(words):
        n = [0] * 6
        for ch in "".join(words):
            n[next(k for k, p in enumerate(kinds) if p.match(ch))] += 1
        return n

    def distance(p, q):
        total = sum(0.5 * (a * np.log2(2 * a / (a + b)) if a else 0) + 0.5 * (b * np.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q))
        return max(total, 0) ** 0.5

    held = {}
    for _, t, lang, *_ in rows:
        if lang is not None:
            w = WORD.findall(t or "")
            h = held.setdefault(lang, (Counter(), [0] * 6))
            h[0].update(w)
            h[1][:] = [a + b for a, b in zip(h[1], classes(w))]
    out = []
    for _, t, lang, *_ in rows:
        w = WORD.findall(t or "")
        words, cls = held.get(lang, (Counter(), []))
        if len(w) < 50 or sum(words.values()) < 2000:
            out.append((None, None))
            continue
        top = sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[:32]
        own, n, all_words = Counter(w), classes(w), sum(words.values())
        p = [own[x] / len(w) for x, _ in top]
        q = [c / all_words for _, c in top]
        out.append((distance([x / sum(n) for x in n], [x / sum(cls) for x in cls]), distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])))
    return out


def quality_corpus():
    r = random.Random(31)
    speech = {lang: ["".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdeé."), ("bb", "fghijßA"), ("cc", "klm1"))}
    rows = []
    for i in range(150):
        lang = r.choice(["aa", "aa", "bb", "cc", None])
        base = speech[r.choice(["aa", "bb"]) if lang is None or r.random() < 0.2 else lang]
        words = [base[min(int(r.expovariate(0.08)), 59)] for _ in range(r.choice([5, 49, 50, 51, 120, 200]))]
        rows.append((i, r.choice([" ", "\n"]).join(words), lang, "s", 0))
    rows += [(900, None, "aa", "s", 0), (901, "", "bb", "s", 0), (902, "x y " * 100, "aa", "s", 0), (903, "12 $$ <> " * 60, "aa", "s", 0), (904, "x " * 60, "rare", "s", 0), rows[0]]
    return rows


def test_quality_distances(spark):
    rows = quality_corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = Counter()
    for x in quality_rules.quality_rules(df, quality_rules.language_references(df)).collect():
        got[(x.doc_id, x.base_failed, x.kept, *(None if d is None else round(d, 9) for d in (x.class_distance, x.word_distance)))] += 1
    want, judged = Counter(), []
    for row, (c, w) in zip(rows, slow_distances(rows)):
        n = brute_quality(row[1])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        kept = not failed and not (c is not None and (c > quality_rules.MAX_CLASS_DISTANCE or w > quality_rules.MAX_WORD_DISTANCE))
        want[(row[0], failed, kept, None if c is None else round(c, 9), None if w is None else round(w, 9))] += 1
        judged.append((failed, kept, c is None))
    assert got == want and {(False, True, False), (False, False, False), (False, True, True), (True, False, False)} <= set(judged)


def test_quality_keeps_the_tables_columns(spark):
    rows = [(1, "aa", "one two", [7], "w", 2.5, "r"), (2, None, None, [8], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, _words array<int>, n_words string, `a.b` double, _row string")
    got = quality_rules.quality_rules(df, quality_rules.language_references(df))
    assert got.columns == ["doc_id", "lang", "text", "_words", "a.b", "_row", *quality_rules.JUDGED]
    assert {(x.doc_id, tuple(x["_words"]), x.n_words, x["a.b"], x["_row"]) for x in got.collect()} == {(1, (7,), 2, 2.5, "r"), (2, (8,), 0, None, None)}
    assert quality_rules.quality_rules(df.limit(0), quality_rules.language_references(df.limit(0))).count() == 0


def test_quality_of_a_long_text(spark):
    r = random.Random(32)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120_000)]
    text = " ".join(words) + "\n" + " ".join(words[:50])
    got = quality_rules.quality_rules(df := spark.createDataFrame([(1, "aa", text)], "doc_id long, lang string, text string"), quality_rules.language_references(df)).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute_quality(text)


def test_added_spans_on_sentences_of_another_hand(spark):
    """Recall and precision of spans on sentences that the trees' examples don't come from."""
    from spans import MARKED, PLAIN

    mark, rows, truth = re.compile(r"\{\{(\w+):(.*?)\}\}"), [], {}
    for i, sentence in enumerate(MARKED + PLAIN):
        text, at, truth[i] = "", 0, []
        for m in mark.finditer(sentence):
            text += sentence[at : m.start()]
            truth[i].append((len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        rows.append((i, text + sentence[at:]))
    hit = found = right = 0
    for x in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [(y.start, y.end) for y in x.all_spans]
        hit += sum(sum(max(0, min(b, d) - max(a, c)) for c, d in spans) >= 0.8 * (b - a) for a, b in truth[x.doc_id])
        found, right = found + len(spans), right + sum(any(c < b and a < d for a, b in truth[x.doc_id]) for c, d in spans)
    known = sum(map(len, truth.values()))
    print(f"recall {hit} of {known}, precision {right} of {found}")
    assert hit >= 0.9 * known and right >= 0.9 * found


def test_spans_keep_the_tables_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", "x", 5, [1]), (2, None, None, None, None)], "doc_id long, text string, _base string, _email int, all_spans array<int>")
    got = pii.find(spark, df)
    assert got.columns == ["doc_id", "text", "_base", "_email", "base_spans", "all_spans"]
    assert {(x.doc_id, x["_base"], x["_email"], len(x.base_spans)) for x in got.collect()} == {(1, "x", 5, 1), (2, None, None, 0)}
    assert pii.find(spark, df.limit(0)).count() == 0


def luhn(s):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(s))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
VALID = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and luhn(d), "phone": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15}


def test_personal_data(spark):
    r = random.Random(5)
    texts = ["", None, "a@b.c_x@d.e a@b", "1.2.3.4.5.6.7.8 300.1.1.1 00.1.02.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713.", "é +49 30 1234567 x", "@" * 50, "a" * 5000 + "@x", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" end', "plain words at home. Nothing"]
    texts += ["".join(r.choice("a1. -@+()é") for _ in range(200)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x for x in found.select("doc_id", pii.written_spans(found["base_spans"]).alias("base"), pii.written_spans(found["all_spans"]).alias("all"), pii.redacted(found["text"], found["all_spans"]).alias("red")).collect()}
    for i, t in rows:
        want = [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if VALID[k](m[0])]
        assert got[i].base == ",".join(want) and set(want) <= set(got[i].all.split(",")) | {""}
    assert "secret:9:49" in got[9].all and got[9].red == 'token = "[SECRET]" end' and got[10].all == ""


def test_long_secrets(spark):
    r = random.Random(6)
    secret = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = [(n, f'token = "{secret(n)}" end') for n in (40, 512, 513, 3000)]
    found = pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.red for x in found.select(pii.redacted(found["text"], found["all_spans"]).alias("red")).collect()} == {'token = "[SECRET]" end'}


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, "w" * r.choice([0, 3, 700, 1024, 1023, 2500, r.randint(0, 1500)])) for i in range(300)] + [(1000, None)]
    encoder = lambda: lambda t: np.arange(1, len(t) + 1, dtype="<u4").tobytes()
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), encoder).toPandas()
    for i, t in rows:
        n = len(t or "") + 1
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == n and (mine.start == np.r_[0, mine.length.cumsum()[:-1]]).all() and (mine.doc_tokens == n).all()
        ids = np.r_[np.arange(1, n), 0].astype("<u4")
        assert all(zlib.crc32(ids[a : a + k].tobytes()) == c for a, k, c in zip(mine.start, mine.length, mine.ids_crc32))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 1024 and (s.offset == np.r_[0, s.length.cumsum()[:-1]]).all()
    assert got.sequence_id.nunique() == brute_best_fit(got.length.tolist())


def brute_best_fit(lengths, window=1024):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(c, i) for i, c in enumerate(room) if c >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(window - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    counts = Counter(r.choice([r.randint(1, 64), r.randint(1, 20)]) for _ in range(300))
    rows = packing.plan(counts, 64)
    assert max(s + k for _, _, k, s, _ in rows) == brute_best_fit(counts.elements(), 64)
    assert sum(k for _, _, k, _, _ in rows) == 300


def test_bpe_equals_library(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = vocabularies.path("word_bpe_49k.json")
    texts = [None, "", " \n\t ", "The  Of é Straße's 12 don't<|endoftext|>X İ ΣΑΣ", "a\x1cb\x0b c d", "é café", "日本語 テスト 👍🏽", "!!! ...'s've", "x" * 3000]
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, full=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids, skip_special_tokens=False)


def test_byte_bpe_equals_library():
    vocabularies = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    lib, encode = Tokenizer.from_file(path), packing.library_encoder(path)()
    same = lambda t: np.frombuffer(encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    for t in ["", "a", " a b", "a  b", "a \n b", "x\ny z", "it's 12 <|endoftext|> ok", "tab\tq ", "é 日本 👍", "a  b", " ", "\n\n", "w" * 5000]:
        assert same(t), repr(t)
    r = random.Random(7)
    parts = ["a", "b ", " ", "  ", "\n", "\t", "'s", "!", "1", "é", "\x0b", "\x1c", "\xa0", "<|endoftext|>", "\r", "日", "\u2003", "\u200b", "\x85"]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert same(t), repr(t)
    long = " " * 2_000_000
    assert same(long) and same("word " * 50_000)


def test_packing_of_whole_texts(spark):
    """The query's encoder: null, empty, repeated and long texts, a null id, clashing columns, an empty table."""
    vocabularies = pytest.importorskip("public_tokenizers")
    encoder = packing.library_encoder(vocabularies.path("byte_bpe_50k.json"))
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, "one two", 5, "x"), (3, "one two", 5, "x"), (None, "three", 5, "x"), (4, " " * 2_000_000, 5, "x")]
    schema = "doc_id long, text string, length int, sequence_id string"
    got = packing.pack(spark, spark.createDataFrame(rows, schema), encoder).toPandas()
    n = lambda i: got[got.doc_id.isna() if i is None else got.doc_id == i].length.sum()
    assert n(1) == n(2) == 1 and n(3) == 2 * (1 + len(encoder()("one two")) // 4) and n(None) > 1 and n(4) == 1 + len(encoder()(" " * 2_000_000)) // 4
    assert packing.pack(spark, spark.createDataFrame([], schema), encoder).count() == 0


def test_bpe_merges_by_rank_then_place():
    """The queue against a plain loop that scans for the smallest rank each time."""
    r = random.Random(11)
    pairs = [(a, b) for a in range(6) for b in range(6)]
    r.shuffle(pairs)
    ranks, made = {a << 32 | b: i for i, (a, b) in enumerate(pairs)}, [r.randrange(6, 9) for _ in pairs]
    for a, b in [(6, 1), (7, 7), (2, 8)]:
        ranks[a << 32 | b] = len(made)
        made.append(3)

    def slow(x):
        x = list(x)
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(a << 32 | b for a, b in zip(x, x[1:])) if p in ranks), default=None)
            if best is None:
                return x
            x[best[1] : best[1] + 2] = [made[best[0]]]

    for n in (1, 2, 3, 9, 40):
        for _ in range(40):
            x = [r.randrange(6) for _ in range(n)]
            assert bpe.merge(x, ranks, made) == slow(x)


def test_bpe_defined_cases(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    path, schema = vocabularies.path("word_bpe_49k.json"), "doc_id long, text string, ids int, _words string"
    rows = [(1, "Same text", 1, "a"), (1, "Same text", 1, "a"), (None, "x", 1, "a"), (2, None, 1, "a"), (3, "word " * 60_000, 1, "a")]
    got = bpe.encode_documents(spark.createDataFrame(rows, schema), path).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1, 2: 1, 3: 1}
    assert len({(r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == 1}) == 1
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == 0 and by[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() and by[3].n_tokens == 60_000
    assert bpe.encode_documents(spark.createDataFrame([], schema), path).count() == 0


def test_classifier(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() + ("$$$" if i % 3 == 0 else "") for _ in range(40))) for i in range(300)] + [(900, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    w = classifier.fit(docs, labels)
    got = {x.doc_id: x.score for x in classifier.score(spark, docs, w).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in held]) > 0.95 and 0 <= got[900] <= 1
    none = classifier.fit(docs, labels.limit(0))
    assert all(x.score == 0.5 for x in classifier.score(spark, docs, none).collect())


def test_ftrl_equals_plain_loops():
    """Weights and scores against the update rule written out number by number."""
    r = random.Random(51)
    texts = [" ".join(r.choice(["good", "bad", "so", "and", "the", "x1"]) for _ in range(r.randint(0, 12))) for _ in range(40)]
    rows = [(t.encode(), int("good" in t)) for t in texts]
    dims, alpha, beta, l1, l2 = classifier.DIMS, 1.0, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - l1 * (1 if a > 0 else -1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    made = classifier.features([t for t, _ in rows])
    for _ in range(3):
        for (idx, value), (_, y) in zip(made, rows):
            x = [*zip(idx.tolist(), value.tolist()), (dims, 1.0)]
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x)))
            grads = [(i, (p - y) * v, weight(i)) for i, v in x]
            for i, g, w in grads:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    got = classifier.train(rows, updates=1)
    used = np.flatnonzero(got)
    assert len(used) and np.allclose(got[used], [weight(i) for i in used.tolist()]) and all(abs(weight(i)) < 1e-12 for i in z if i not in set(used.tolist()))
    for idx, value in made:
        assert len(set(idx.tolist())) == len(idx) and (not len(value) or abs((value * value).sum() - 1) < 1e-9)


def test_training_rows_are_bounded(spark):
    rows = [(1, f"text {k}") for k in range(50)] + [(k, "other") for k in range(2, 40)] + [(None, "x")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)] + [(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classifier.training_rows(docs, labels, 10).collect()
    assert len(got) == 10 and len({x.doc_id for x in got}) == 10
    every = {x.doc_id: (x.text, x.label) for x in classifier.training_rows(docs, labels).collect()}
    assert every.get(1, ("text 0", 1)) == ("text 0", 1) and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in every)
    w = classifier.fit(docs, labels)
    scored = classifier.score(spark, docs, w)
    assert scored.count() == len(rows) and scored.filter("doc_id IS NULL").count() == 1 and classifier.score(spark, docs.limit(0), w).count() == 0


def test_main_text(spark):
    p = "The quick of the and to in it is a story of the people and the town that was in the hills for all of them and it is told here. " * 3
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; co</h1><p>{p}<p>Short.<p>{p}</article><div id=comments><p>{p}</div><footer>&copy; me</footer></body></html>"
    want = f"Title & co\n{p.strip()}\nShort.\n{p.strip()}"
    assert html_text.main_text(page) == want
    assert html_text.main_text(None) == "" and html_text.main_text("<nav><a>x</a></nav>") == "" and html_text.main_text("<!-- open") == ""
    plain = f"<body><div><a href=x>One</a> <a href=y>Two</a></div><div>{p}</div><div>Short one.</div><div>{p}</div></body>"
    assert html_text.main_text(plain) == f"{p.strip()}\nShort one.\n{p.strip()}"
    got = html_text.extract(spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.n_chars for r in got} == {1: len(want), 2: 0}


PROSE = "The quick of the and to in it is a story of the people and the town that was in the hills for all of them and it is told here."


def test_main_text_of_made_pages(spark):
    """Pages put together from known parts: exactly the article's blocks come back, whatever the markup around and in them."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    some = lambda a, b: " ".join(r.choice([word(), word(), "the", "and", "of"]) for _ in range(r.randint(a, b)))
    rare = lambda a, b: " ".join(word() + "q" for _ in range(r.randint(a, b)))
    noise = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a>' for _ in range(5))}</ul></nav>",
        lambda: f'<div class="ad-box">{PROSE}</div>',
        lambda: f"<aside>{PROSE} {PROSE}</aside>",
        lambda: f"<form action='x'><p>{PROSE}</p><input><button>Go</button></form>",
        lambda: f"<div id=comments><p>{PROSE}</p></div>",
        lambda: f"<script>if (a < b) document.write('<p>{PROSE}</p>')</script><style>p{{}}</style>",
        lambda: f"<!-- <p>{PROSE}</p> -->",
        lambda: f"<footer>&copy; {word()}</footer>",
        lambda: f"<div class='cookie-notice'>{PROSE}</div>",
    ]
    rows = []
    for i in range(120):
        texts = [r.choice([some(1, 4), some(20, 80), rare(15, 40), rare(1, 3), PROSE])for _ in range(r.randint(1, 7))]
        body = []
        for t in texts:
            words = t.split()
            k = r.randrange(len(words))
            words[k] = r.choice([f"<b>{words[k]}</b>", f"<i title=it's>{words[k]}</i>", f"<span data-x='a>b'>{words[k]}</span>", words[k] + "<!-- x -->", words[k]])
            body.append(r.choice(["<p>{}</p>", "<p title=it's>{}", "<p>{}", "<div>{}</div>", "<h2 class=big>{}</h2>", "<section><p>{}</p></section>"]).format(r.choice([" ", "\n  "]).join(words)))
        page = "".join(r.choice(noise)() for _ in range(r.randint(0, 4))) + "<article>" + "".join(body) + "</article>" + "".join(r.choice(noise)() for _ in range(r.randint(0, 4)))
        rows.append((i, "u", f"<html><head><title>{word()}</title></head><body>{page}</body></html>", "\n".join(texts)))
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, _, page, want in rows:
        assert got[i] == want, page


def test_rules_decide():
    """Stop words, links and length move blocks both in and outside articles."""
    long = PROSE + " " + PROSE
    rare = " ".join(f"zxq{k}" for k in range(40))
    links = "<p>" + " ".join(f"<a href=x>link number {k}</a>" for k in range(20)) + "</p>"
    text = lambda body: html_text.main_text(f"<body>{body}</body>")
    assert text(f"<div>{long}</div><div>{rare}</div><div>{long}</div>") == f"{long}\n{rare}\n{long}"
    assert text(f"<div>{rare[:150]}</div>") == "" and text(f"<div>{long}</div>") == long
    assert text(f"<article><p>{long}</p>{links}<p>{rare}</p>{links}</article>") == long  # an unsure block between link lists
    assert text(f"<article><p>{long}</p><p>{rare}</p></article>") == f"{long}\n{rare}" and text(f"<article><p>{rare}</p></article>") == rare
    assert text(f"<article><p>Teaser.</p></article><div>{long}</div><div>{long}</div>") == f"{long}\n{long}"
    assert text(f"<div>{long} \xa9 2020 by the town</div>") == f"{long} \xa9 2020 by the town"
    assert text(f"<article><p title=it's>{long}</p><p>{long}</p></article>") == f"{long}\n{long}"


def test_main_text_defined_cases(spark):
    long = " ".join([PROSE] * 20_000)
    rows = [(1, "u", f"<article><p>{long}</p></article>", 1), (1, "u", f"<article><p>{long}</p></article>", 1), (None, None, f"<p>{PROSE * 3}</p>", 1), (2, "u", "", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert Counter((x.page_id, x.n_chars) for x in got) == {(1, len(long)): 2, (None, len(PROSE * 3)): 1, (2, 0): 1}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for broken in ("<p <b> \"x", "<p a='" + "x" * 100_000, "<" * 50_000, "<a " * 20_000, "&#x110000; &bogus; &amp"):
        html_text.main_text(broken)


def test_text_after_inline_furniture():
    p = "The quick of the and to in it is a story of the people and the town that was in the hills for all of them and it is told here. " * 3
    p = p.strip()
    for tag in ('span class="tags"', "i hidden", 'em id="share"', 'label aria-hidden="true"', "time style='display: none'", "x-y class=ad"):
        end = tag.split()[0]
        assert html_text.main_text(f"<p>{p} <{tag}>x</{end}> rest</p>") == f"{p} rest"
        assert html_text.main_text(f"<article><{tag}></{end}><p>{p}</p><p>{p} <{tag}><{end}>x</{end}><b>y</b></{end}>rest</p></article>") == f"{p}\n{p} rest"
        assert html_text.main_text(f"<article><{tag}/><p>{p}</p></article>") == p
        assert html_text.main_text(f"<article><p>{p}<{tag}>x<p>{p}<{tag}><div>x</div></{end}>rest</article>") == f"{p}\n{p}\nrest"
    assert html_text.main_text(f"<div>{p}</div><div><span class=share>x</span></div><div>Short one.</div><div><i hidden>x</i></div>") == p
    assert html_text.main_text(f'<article><header class="entry-header"><h1>Title</h1></header><p>{p}</p><header hidden>x</header></article>') == f"Title\n{p}"


def brute_removed(texts, window=200):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        mark = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mark[i : i + window] = True
        kept = bytes(b for b, m in zip(t, mark) if not m)
        yield len(t), int(mark.sum()), int((mark[1:] < mark[:-1]).sum()), hashlib.sha256(kept).hexdigest()


def test_repeated_passages_of_shared_identifiers(spark):
    r = random.Random(61)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    p = " ".join(word() for _ in range(50))
    texts = [f"{word()} {p} {word()}" for _ in range(4)] + [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = [(None, t) for t in texts] + [(5, texts[0] + "!"), (5, texts[5]), (6, None), (7, "")]
    df = spark.createDataFrame([(*x, 3, "t") for x in rows], "doc_id long, text string, n_bytes int, t string")
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(spark, df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_removed([(t or "").encode() for _, t in rows])))
    full = suffix_dedup.remove_repeats(spark, df, full=True).filter("n_removed > 0").collect()
    assert all(x.kept_text.encode() == bytes(x.kept) for x in full) and suffix_dedup.remove_repeats(spark, df.limit(0)).count() == 0


def test_segments_of_a_long_text(monkeypatch):
    data = np.frombuffer(random.Random(62).randbytes(5000), np.uint8)
    whole = suffix_dedup.runs(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = suffix_dedup.runs(data)
    cover = lambda x: {(int(f) + k, int(a)) for a, f, n in zip(*x) for k in range(int(n))}
    assert cover(whole) == cover(parts) and len(parts[0]) >= len(whole[0])


@pytest.mark.parametrize("group", [8192, 2])
def test_repeated_passages(spark, docs, group):
    df, rows = docs
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark, df, group=group).collect())
    want = Counter((r[0], *x) for r, x in zip(rows, brute_removed([(t or "").encode() for _, t, *_ in rows])))
    assert got == want


def test_suffix_order(spark):
    suffix_dedup.register_covered(spark)
    loader = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    cls = loader.loadClass("RepeatedWindows")
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    order = next(m for m in cls.getMethods() if m.getName() == "order")
    r = random.Random(9)
    for n in (1, 2, 5, 40, 200):
        for top in (2, 4):
            t = [r.randint(1, top) for _ in range(n)] + [0]
            a = gateway.new_array(jvm.int, len(t))
            for i, v in enumerate(t):
                a[i] = v
            args = gateway.new_array(jvm.java.lang.Object, 1)
            args[0] = a
            assert list(order.invoke(None, args)) == sorted(range(len(t)), key=lambda i: t[i:])
