"""The pipeline against plain Python, stage by stage and as a whole."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import BASE, VALID, WORD, brute_best_fit, brute_quality, slow_distances

import corpus_pipeline
from cartolith.llm import packing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)


def test_near_copies_with_null_and_repeated_ids(spark):
    r = random.Random(3)
    a, b, c, d = (words(r, 120) for _ in range(4))
    lone = [words(r, 90) for _ in range(4)]
    rows = [(1, a), (2, a + " x"), (None, a + " y"), (None, lone[0]), (None, lone[1]), (2, lone[2]), (2, lone[3])]
    rows += [(None, b), (None, b + " x"), (None, b), (7, c), (7, c + " x"), (7, c), (9, d), (8, d + " x")]
    rows += [(None, ""), (None, ""), (3, None), (3, " ")]
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect())
    kept = [(1, a), (None, lone[0]), (None, lone[1]), (2, lone[2]), (2, lone[3]), (8, d + " x"), (None, ""), (None, ""), (3, None), (3, " ")]
    rest = got - Counter(kept)
    assert not Counter(kept) - got and len(rest) == rest.total() == 2
    assert {i for i, _ in rest} == {None, 7} and {t.removesuffix(" x") for _, t in rest} == {b, c}


def test_repeated_passages_with_null_and_repeated_ids(spark):
    r = random.Random(4)
    p, q = words(r, 60), words(r, 60)
    heads = [words(r, 20) + f"{k}\n" for k in range(6)]  # a repeat begins at the line end
    # The rows of one id have texts of the same length, some of them without a repeat.
    rows = [(5, heads[0] + p), (5, heads[1] + q), (5, heads[2] + words(r, 60)), (None, heads[3] + p), (None, heads[4] + q), (None, heads[5] + words(r, 60))]
    got = sorted(x.text for x in corpus_pipeline.repeated_passages(spark, table(spark, rows), "").collect())
    cut = lambda h, t: h[:-1] if t in (p, q) else h + t
    want = sorted(cut(h, t[len(h) :]) for h, (_, t) in zip(heads, rows))
    assert got == want


def test_cut_texts_keep_their_own_replacement_characters(spark):
    """A character that a cut divides goes; U+FFFD that the text had stays."""
    r = random.Random(5)
    p = words(r, 60)
    rows = [(1, "a � b é" + p), (2, "c � d ê" + p)]  # two-byte letters with a common last byte? they differ in it
    got = sorted(x.text for x in corpus_pipeline.repeated_passages(spark, table(spark, rows), "").collect())
    assert got == ["a � b é", "c � d ê"]
    rows = [(1, "a � b Ã" + p), (2, "c � d ă" + p)]  # C3 83 and C4 83: the cut begins inside the letter
    got = sorted(x.text for x in corpus_pipeline.repeated_passages(spark, table(spark, rows), "").collect())
    assert got == ["a � b ", "c � d "]


# -- plain Python versions of the stages, on rows (doc_id, text, lang, source, n_chars) ------


def slow_quality(rows):
    out = []
    for row, (c, w) in zip(rows, slow_distances(rows)):
        n = brute_quality(row[1])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        far = c is not None and (c > quality_rules.MAX_CLASS_DISTANCE or w > quality_rules.MAX_WORD_DISTANCE)
        if not failed and not far:
            out.append(row)
    return out


def slow_near_copies(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 10 * c >= 8 * (len(sets[i]) + len(sets[j]) - c):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).digest(), rows[k][3] or "", rows[k][2] or "")
    first = {}
    for k in sorted(range(len(rows)), key=order):
        first.setdefault(group[k], k)
    return [row for k, row in enumerate(rows) if not sets[k] or first[group[k]] == k]


def slow_passages(rows, window=200):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for row, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        if gone.any():
            pieces, at = [], 0
            for edge in [*np.flatnonzero(np.diff(gone.astype(int))) + 1, len(d)]:
                if not gone[at]:
                    pieces.append(d[at:edge].decode("utf-8", "ignore"))
                at = edge
            text = "".join(pieces)
            row = (row[0], text, *row[2:4], len(text))
        out.append((*row[:4], None if row[1] is None else len(row[1])))
    return out


def slow_personal(rows):
    """Base patterns, and the secrets that the table below has."""
    out = []
    for row in rows:
        t = row[1]
        if t is not None:
            spans = [(m.start(), m.end(), k) for k in BASE for m in re.finditer(BASE[k], t) if VALID[k](m[0])]
            spans += [(*m.span(1), "secret") for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
            for a, b, k in sorted(spans, reverse=True):
                t = t[:a] + f"[{k.upper()}]" + t[b:]
        out.append((row[0], t, *row[2:4], None if t is None else len(t)))
    return out


def documents():
    """Texts in two languages with junk, near copies, shared passages, personal data, null and repeated ids, empty texts."""
    r = random.Random(71)
    lists = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(400)] for lang, letters in (("aa", "abcdeé"), ("bb", "fghijß"))}
    say = lambda lang, n: " ".join(lists[lang][min(int(r.expovariate(0.02)), 399)] for _ in range(n))
    rows, shared = [], {lang: say(lang, 70) for lang in lists}
    for i in range(120):
        lang = r.choice(["aa", "bb"])
        text = say(lang, r.randint(60, 160))
        if i % 6 == 0:
            text += "\n" + shared[lang] + "\n" + say(lang, 30)
        if i % 9 == 0:
            text += r.choice([" mail some.one@mail.example.org now", " call +49 30 1234567 now", " at 10.2.30.4 now", " card 4111 1111 1111 1111 now", ' token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" now'])
        rows.append((r.choice([i, i, i, None, 7]), text, lang))
        if i % 5 == 0:  # near copies, exact copies, and one that is too different
            w = text.split(" ")
            w[r.randrange(len(w))] = "zz"
            rows += [(500 + i, " ".join(w), lang), (r.choice([600 + i, None]), text, lang), (700 + i, " ".join(w[: len(w) // 2]) + " " + say(lang, 60), lang)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "one two", "aa"), (903, "x y z " * 60, "aa"), (904, "$$ ## " * 80, "bb"), (905, say("bb", 150), "aa"), (906, say("aa", 80), None)]
    return [(i, t, lang, f"src{k % 3}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(rows)]


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    vocabularies = pytest.importorskip("public_tokenizers")
    rows = documents()
    extra = [(*x, 1.5, "own") for x in rows]
    spark.createDataFrame(extra, DOCS + ", extra double, _key string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now, slow = docs, rows
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (slow_quality, slow_near_copies, slow_passages, slow_personal)):
        before = len(slow)
        slow = plain(slow)
        made = stage(spark, now, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert Counter(map(tuple, now.collect())) == Counter(slow), name
        assert name in ("repeated_passages", "personal_data") or len(slow) < before, name
    assert any(t != u for (_, t, *_), (_, u, *_) in zip(slow_passages(slow_near_copies(slow_quality(rows))), slow)) and {x[0] for x in slow} >= {None, 7}
    encode = packing.library_encoder(vocabularies.path("byte_bpe_50k.json"))()
    lengths = Counter()
    for _, t, *_ in slow:
        n = len(encode(t or "")) // 4 + 1
        lengths.update([1024] * (n // 1024) + ([n % 1024] if n % 1024 else []))
    got = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).toPandas()
    assert Counter(got.length.tolist()) == lengths and got.sequence_id.nunique() == brute_best_fit(lengths.elements())
    assert Counter(x.length for x in corpus_pipeline.run(spark, str(tmp_path)).select("length").collect()) == lengths


def test_stages_on_an_empty_table(spark, tmp_path):
    now = spark.createDataFrame([], DOCS)
    now.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, str(tmp_path))
        assert made.count() == 0, name
        now = made if name != "packing" else now


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "repeated_passages", "personal_data", "packing"]
