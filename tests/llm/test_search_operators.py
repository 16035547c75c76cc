"""Spelling variants, ranked search and repeated spans against brute force on small inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import common, debruijn, lexical, variants

DOCS = "doc_id long, text string, word string, n long, doc long, score double, spans string, start int"


def frame(spark, rows):
    common.prepared(spark)
    return spark.createDataFrame([(i, t, "w", 7, 8, 0.5, "x", 9) for i, t in rows], DOCS)


# --- spelling variants ------------------------------------------------------------------------


def wanted_variants(rows, every=97):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if a == b or len(a) - len(b) > 1:
            return False
        k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
        return a[k + 1 :] == b[k + (len(a) == len(b)) :]

    beside = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in beside.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(beside[w]), words.get(form.get(w))) for w, n in words.items()}


def variant_rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("tile", [2, 256])
def test_variants_equal_all_pairs(spark, tile):
    r = random.Random(tile)
    base = ["".join(r.choice("abÀÿ×") for _ in range(r.randint(5, 9))) for _ in range(120)]
    some = [*base, *("aaaaa" + "".join(r.choice("ab") for _ in range(4)) for _ in range(60)), "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(some, k=200))) for i in range(40)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, None), (98, ""), (99, "1 2 3 ---")]
    rows += [(400, "chain " * 3 + "chains " * 8 + "chainss " * 20)]
    got = variants.spelling_variants(frame(spark, rows), tile=tile)
    wanted = wanted_variants(rows)
    assert variant_rows(got) == wanted
    assert any(w[1] for w in wanted) and any(w[2] != w[0] and w[2] != w[1] for w in wanted)


def test_misspelling_rule_and_empty_table(spark):
    rows = [(i, "Wonderful wonderful änderung") for i in range(400)]
    assert variant_rows(variants.spelling_variants(frame(spark, rows), every=5)) == wanted_variants(rows, 5)
    assert variant_rows(variants.spelling_variants(frame(spark, rows[:0]))) == set()
    assert variant_rows(variants.spelling_variants(frame(spark, [(None, None)]))) == set()


def test_blocks_get_small_and_pairs_are_told_once(spark):
    words = [("aaaa" + "".join(chr(97 + k // 5**j % 5) for j in range(4)), 3) for k in range(625)]
    common.prepared(spark)
    placed = variants.blocks(spark.createDataFrame(words, "word string, n long"), tile=20)
    assert placed.groupBy(*variants.KEY).count().agg({"count": "max"}).first()[0] <= 20
    near = {r.word: r.n_near for r in variants.near_words(placed).collect()}
    assert len(near) == 625 and set(near.values()) == {16}


# --- ranked search ----------------------------------------------------------------------------


def wanted_ranks(docs, items, top=20):
    split = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def terms(text):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in split.findall(text or "")]

    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 75 + (25 * bag.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -less) for k, (less, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def random_corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Äpfel", "日本", "x_y", "A-B"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([0, 3, 30, 300])))) for i in range(n)], r


def test_search_equals_full_scoring(spark):
    docs, r = random_corpus(1, 400)
    docs += [(400 + k, docs[7][1]) for k in range(60)] + [(3, "w5 w5 w9"), (None, "w5 w290"), (None, None), (900, "  --"), (901, "w299 " * 5000)]
    items = [(k, docs[r.randrange(400)][1][:120].upper()) for k in range(25)] + [(1, "w299 w299 unknown"), (None, "w290 W5"), (50, None), (51, "!!"), (52, docs[7][1])]
    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, query int, doc long")
    got = [tuple(x) for x in lexical.search(frame(spark, docs).repartition(3), queries).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == wanted_ranks(docs, items)


def test_search_in_blocks_of_queries_and_of_nothing(spark, monkeypatch):
    docs, _ = random_corpus(2, 60)
    items = [(k, t[:200]) for k, t in docs[:30]]
    monkeypatch.setattr(lexical, "QUERY_BYTES", 1500)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in lexical.search(frame(spark, docs), queries, top=3).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == wanted_ranks(docs, items, 3)
    assert lexical.search(frame(spark, docs), queries.limit(0)).count() == 0
    assert lexical.search(frame(spark, docs[:0]), queries.limit(2)).count() == 0


def test_bounds_hold_and_few_are_scored(spark):
    docs, _ = random_corpus(3, 500)
    blocks = lexical.index(frame(spark, docs), []).collect()
    vocabulary = sorted({t for _, x in docs for t in lexical.terms(x)})
    total = sum(b.docs for b in blocks)
    queries = lexical.Queries(vocabulary, [1000] * len(vocabulary), [[(k, 1)] for k in range(len(vocabulary))], total, sum(b.n_terms for b in blocks))
    above = 0
    for block in blocks:
        ids, bounds = lexical.upper_bounds(queries, block.asDict())
        for column, i in enumerate(ids.tolist()):
            bag = collections.Counter(lexical.terms(docs[i][1]))
            m = queries.length_part(bag.total())
            exact = np.array([1000 * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in vocabulary])
            assert (bounds[:, column] >= exact).all()
            above += (bounds[:, column] > exact).mean()
    assert above / total < 0.05


# --- repeated spans ---------------------------------------------------------------------------


def wanted_spans(rows):
    """By (id, text) in order; null ids last."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for i, text in order:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def span_rows(df):
    return sorted((tuple(r) for r in debruijn.digests(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def passages(seed, n):
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(500)] + ["é", "日本語", "\x1c", "\x85"]
    shared = [r.choices(vocabulary, k=r.randint(15, 80)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            part = r.choice(shared) if r.random() < 0.6 else r.choices(vocabulary, k=r.randint(1, 30))
            low = r.randrange(len(part)) if r.random() < 0.3 else 0
            words += part[low:]
        rows.append((i, "".join(w + r.choice([" ", "\n", "\t ", "\x0b"]) for w in words)))
    return rows, r


def test_spans_equal_brute_force(spark):
    rows, r = passages(5, 150)
    rows += [(200, "a " * 300), (201, "a " * 100), (202, "a b " * 120), (203, None), (204, ""), (205, "b a " * 50), (206, rows[3][1] + " " + rows[3][1])]
    changed = rows[4][1].split()
    rows += [(300 + k, " ".join(w if j != k else "other" for j, w in enumerate(changed))) for k in range(0, len(changed), 7)]
    assert span_rows(debruijn.remove_repeats(frame(spark, rows).repartition(5))) == wanted_spans(rows)


def test_spans_of_repeated_and_missing_ids(spark):
    rows, _ = passages(6, 40)
    rows += [(3, rows[9][1]), (3, rows[9][1]), (None, rows[9][1]), (None, rows[10][1]), (None, None)]
    got = debruijn.remove_repeats(frame(spark, rows), carry=("word", "start"))
    assert span_rows(got) == wanted_spans(rows) and got.columns[-2:] == ["word", "start"]
    assert debruijn.remove_repeats(frame(spark, rows[:0])).count() == 0
    assert debruijn.remove_repeats(frame(spark, [(1, "too short")])).first().kept == "too short"


def test_spans_of_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "SLICE_WORDS", 97)
    monkeypatch.setattr(debruijn, "CHUNK_BYTES", 211)
    rows, r = passages(7, 60)
    long = " ".join(t for _, t in rows)
    rows += [(100, long), (101, "new " * 30 + long[len(long) // 3 :]), (102, "y" * 100_000 + " " + long)]
    texts = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    # Slices are set in this process, so the parts are tried here and the result on Spark with the usual ones.
    hashes, bounds = debruijn.word_hashes([t.encode() for _, t in rows])
    words = [w for _, t in rows for w in t.encode().split()]
    assert bounds[-1] == len(words) and len({(a, b) for a, b in zip(*hashes)}) == len(set(words))
    found = debruijn.walks(hashes, bounds)
    covered = collections.Counter((i, s + k) for i, s, n in zip(found["text"].tolist(), found["start"].tolist(), found["windows"].tolist()) for k in range(n))
    assert covered == collections.Counter((i, k) for i, (_, t) in enumerate(rows) for k in range(len(t.encode().split()) - 19))
    assert span_rows(debruijn.remove_repeats(texts)) == wanted_spans(rows)


def test_paths_have_no_branches(spark):
    common.prepared(spark)
    a, b, c = ([f"{x}{k}" for k in range(60)] for x in "abc")
    rows = [(1, a + b), (2, ["x"] + a + c), (3, ["y"] + a + b), (4, ["z"] + a + c), (5, b[5:])]
    texts = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc long, text string")
    spans = {r.doc: [(s.start, s.windows, s.path_doc, s.path, s.offset) for s in sorted(r.spans, key=lambda s: s.start)] for r in debruijn.repeated_spans(texts).collect()}

    def joined(parts):
        out = []
        for start, windows, doc, path, offset in parts:
            if out and out[-1][0] + out[-1][1] == start and out[-1][2:4] == (doc, path) and out[-1][4] + out[-1][1] == offset:
                out[-1] = (out[-1][0], out[-1][1] + windows, *out[-1][2:])
            else:
                out.append((start, windows, doc, path, offset))
        return out

    got = {doc: joined(parts) for doc, parts in spans.items()}
    # The path over a ends where b and c part; those begin with the window that first holds a word of theirs.
    assert got == {2: [(1, 41, 1, 0, 0)], 3: [(1, 41, 1, 0, 0), (42, 60, 1, 41, 0)], 4: [(1, 41, 1, 0, 0), (42, 60, 2, 42, 0)], 5: [(0, 36, 1, 41, 24)]}
