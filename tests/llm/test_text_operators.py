"""Tokenizers, packing, MinHash, run-length index and fingerprints against brute force on small inputs."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidewatch.llm import byte_bpe, common, fingerprints, minhash, packing, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def frame(spark, rows):
    common.prepared(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows], DOCS)


def random_texts(seed, n, letters="ab  \n\té中😀're1239.,! \x1c\x85<|endoftext|>", most=40):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


# --- byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queue_merges_as_the_library(reference):
    tool = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in [*random_texts(1, 3000), "a" * 20_000, "ab" * 9_000, "=-" * 500 + "!" * 3_000, " " * 700, "x\n\n  y "]:
        ids = tool.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert tool.decode(ids) == text.encode()
    assert not any(tool.words)


def test_encode_rows(spark, reference):
    texts = ["Hello there, world", None, "", "Hello there, world", "é" * 300]
    docs = frame(spark, list(enumerate(texts)) + [(None, "x")])
    path = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in byte_bpe.encode_digests(docs, path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[None].n_tokens == 1
    back = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {**{i: t or "" for i, t in enumerate(texts)}, None: "x"}
    assert byte_bpe.encode_digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_small_groups_and_caches_give_the_same_ids(reference, monkeypatch):
    for name, value in {"GROUP_CHARS": 90, "QUEUE_CHARS": 40, "CACHED_PIECES": 30, "CACHED_LENGTH": 5, "SLICE_IDS": 7}.items():
        monkeypatch.setattr(byte_bpe, name, value)
    tool = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["", *random_texts(5, 800), "", "word " * 60, "x" * 300, "=" * 200]
    for text, ids in zip(texts, tool.encode_all(texts), strict=True):
        wanted = reference.encode_ordinary(text)
        assert ids.tolist() == wanted
        assert tool.digests(ids) == tuple(hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, wanted)).encode(), text.encode()))
        assert max(map(len, tool.older), default=0) <= 5
    assert not any(tool.words) and not any(tool.buckets)


def test_words_that_return_are_merged_once(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 20)
    monkeypatch.setattr(byte_bpe, "CACHED_CHUNKS", 20, raising=False)
    tool = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    merge, merged = tool.merge, []

    def counted(pieces):
        merged.extend([pieces] if isinstance(pieces, bytes) else pieces)
        return merge(pieces)

    tool.merge = counted
    for k in range(100):
        tool.encode(f"a returningly qz{k * 7919:x}qz")
    assert merged.count(b" returningly") == 1
    assert len(tool.pieces) + len(tool.older) < 60


def test_merges_that_bring_up_a_lower_rank(tmp_path):
    r = random.Random(6)
    for case in range(60):
        tokens = [bytes((b,)) for b in range(256)]
        while len(tokens) < 300:
            token = bytes(r.choice(b"abc") for _ in range(r.randint(2, 5)))
            if token not in tokens:
                tokens.append(token)
        if case % 2:  # bytes go last, and some of no use are left out
            tokens = [t for t in tokens[::-1] if t != b"\xff"]
        path = tmp_path / f"{case}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
        tool = byte_bpe.Encoder(str(path), P.PATTERN)
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
        texts = ["".join(r.choice("abc" if k % 2 else "aaab c") for _ in range(r.randint(0, 80))) for k in range(40)]
        assert [ids.tolist() for ids in tool.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
        assert not any(tool.words) and not any(tool.buckets)


# --- packing ----------------------------------------------------------------------------------


def test_two_small_pieces_replace_the_smallest():
    plan = packing.best_two_fit({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    assert plan[0] == (1, [60, 21, 19])  # 60 + 30 leaves 10; 30 gives way to 21 and 19
    assert plan[1:] == [(1, [30])]


def test_plans_use_every_piece_once():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(1, 30))}
        used = collections.Counter()
        for times, lengths in packing.best_two_fit(counts, 64):
            assert sum(lengths) <= 64 and times >= 1
            for n in lengths:
                used[n] += times
        assert used == counts


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)
    texts = [t for t in random_texts(3, 60, "abc de\n", 90)] + [None, "", "word " * 9000, "a  b", "<|endoftext|>"]
    docs = frame(spark, list(enumerate(texts)))
    path = P.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    rows = packing.pack_documents(docs, path, P.PATTERN).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 2048 for p in pieces[1:]) and (len(ids) > 2048) == (len(pieces) > 1)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in pieces) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), path, P.PATTERN).count() == 0


def test_added_tokens_have_their_ids(spark, tmp_path):
    from tidewatch.llm import queries

    mark = "<|endoftext|>"
    texts = [t.replace("#", mark) for t in random_texts(4, 80, "ab  #\n'é1", 60)]
    texts += [mark, mark * 3, f"a {mark}  b", f" \n {mark} \n", f"<|endof{mark}text|>", "<|endoftext|", f"{'word ' * 3000}{mark}{' x' * 100}", "", None]
    docs = frame(spark, list(enumerate(texts)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc = collections.defaultdict(list)
    for r in queries.packing_query(spark, str(tmp_path)).collect():
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        assert sum(p.length for p in by_doc[i]) == len(ids)
        for p in by_doc[i]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


# --- MinHash ----------------------------------------------------------------------------------


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace(" ", " ")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(seed):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([3, 5, 40, 200]))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
            rows.append((i, (" ".join(w)).upper() if r.random() < 0.2 else "\n".join(w)))
            i += r.randint(1, 3)
    return rows + [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rows = near_copies(4)
    wanted, sizes = brute_components(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_edges(spark):
    same = "a b c d e f g"
    got = minhash.near_duplicates(frame(spark, [(1, same), (1, same), (None, same), (2, same)])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_circulant_coordinates_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1500], np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))])
    x, y = minhash.signatures([a, np.sort(b)], 384)
    assert abs((x == y).mean() - 1500 / 2500) < 0.1


def test_exact_links_join_all_that_pairs_would():
    r = random.Random(9)
    for _ in range(30):
        universe = list(range(60))
        sets = [np.array(sorted(r.sample(universe, r.randint(1, 40))), np.uint64) for _ in range(10)]
        for _ in range(12):
            s = set(r.choice(sets).tolist())
            s ^= {r.choice(universe)}
            if s:
                sets.append(np.array(sorted(s), np.uint64))
        ids = np.arange(len(sets))
        group = {i: {i} for i in ids.tolist()}

        def join(a, b, of):
            if of[a] is not of[b]:
                merged = of[a] | of[b]
                for k in merged:
                    of[k] = merged

        other = {i: {i} for i in ids.tolist()}
        for a in ids.tolist():
            for b in ids.tolist():
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if a < b and 100 * len(x & y) >= 85 * len(x | y):
                    join(a, b, group)
        for a, b in minhash.exact_links(ids, sets, 85):
            join(a, b, other)
        assert group == other


# --- run-length index -------------------------------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(w)
        out[i] = (len(b), sum(mask), sum(mask[k] and not (k and mask[k - 1]) for k in range(len(b))), hashlib.sha256(bytes(c for c, m in zip(b, mask) if not m)).hexdigest())
    return out


def repetitive(seed, n=14):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé f") for _ in range(r.choice([50, 120, 300, 700]))) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            i = r.randint(0, len(b))
            t += b[i : r.randint(i, len(b))] + "".join(r.choice("xyz") for _ in range(r.randint(0, 3)))
        t += r.choice(["", "", "q" * r.randint(0, 400), "ab" * r.randint(0, 200)])
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed,large", [(1, 1 << 30), (2, 1 << 30), (3, 0)])
def test_repeats_are_those_of_all_strings(spark, monkeypatch, seed, large):
    monkeypatch.setattr(suffix, "LARGE_BYTES", large)
    rows = list(enumerate([*repetitive(seed), None, "", "x" * 99, "y" * 300]))
    got = suffix.digests(suffix.remove_repeats(frame(spark, rows).repartition(5))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


def test_repeats_edges(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(150))
    got = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, [(None, text), (5, text), (5, text), (6, text + "é" * 3)])).collect()}
    assert got[5].n_removed == 0 and got[6].n_removed == 150 and got[None].n_removed == 150 and len(got) == 3
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_run_heads_give_every_match():
    r = random.Random(3)
    for _ in range(20):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(6)]
        data, ends = [], []
        for t in texts:
            data += [ord(c) + 1 for c in t] + [0]
            ends.append(len(data) - 1)
        index = suffix.RunLengthIndex(np.array(data, np.uint16), np.array(ends))
        before, length = index.matches()
        joined = "".join(t + "\0" for t in texts)
        for row, place in enumerate(index.order.tolist()):
            if joined[place] == "\0":
                continue
            own = joined[place : joined.index("\0", place)]
            if row == 0 or before[place] < 0:
                continue
            other = joined[before[place] : joined.index("\0", before[place])]
            common = next((k for k, (a, b) in enumerate(zip(own, other)) if a != b), min(len(own), len(other)))
            assert before[place] == index.order[row - 1] and length[place] == common
        assert len(index.run_rows) <= len(data)


# --- fingerprints -----------------------------------------------------------------------------


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SEGMENT_ROWS", 5)
    r = random.Random(6)
    texts = ["\n".join(" ".join(f"w{r.randint(0, 900)}" for _ in range(20)) for _ in range(r.randint(1, 6))) for _ in range(30)]
    texts[3], texts[7], texts[8], texts[20] = None, "", texts[9], "é😀x"
    ids = r.sample(range(1000), 30)
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(frame(spark, list(zip(ids, texts)))).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % 30][1] or ""
        cut = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()
    by_text = collections.defaultdict(set)
    for i, t in zip(ids, texts):
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)
    long = [got[i] for i, t in zip(ids, texts) if t and len(t) > 200]
    assert np.mean([x.near_edited for x in long]) > 0.5 > 0.2 > np.mean([x.near_next for x in long if x.near_next < 1])
    assert all(0 <= v <= 1 for x in got.values() for v in (x.near_edited, x.near_next))


def test_fingerprint_edges(spark):
    one = fingerprints.fingerprint_edits(frame(spark, [(1, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = fingerprints.fingerprint_edits(frame(spark, [(1, "b"), (1, "a"), (None, "abc")])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 3), (1, 1)]
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0


def test_paragraphs_go_in_and_out(spark):
    from pyspark.sql import functions as F

    texts = frame(spark, [(1, "a b c\nd e\nf g h"), (2, "f g h\na b c\nd e"), (3, "a b c\nf g h"), (4, "d e")]).repartition("doc_id")
    sums = fingerprints.paragraph_sums(texts.select("doc_id", "text"), "doc_id")
    v = {r.doc_id: r for r in sums.select("doc_id", fingerprints.vector(F.col("sums")).alias("v")).collect()}
    assert v[1].v == v[2].v != v[3].v
    row = spark.createDataFrame([(v[3].v, v[4].v, v[1].v)], "a array<long>, p array<long>, w array<long>")
    both = row.select(fingerprints.insert(F.col("a"), F.col("p")).alias("i"), fingerprints.delete(F.col("w"), F.col("p")).alias("d")).first()
    assert both.i == v[1].v and both.d == v[3].v


# --- repeated ids -----------------------------------------------------------------------------


def repeated_ids(seed):
    """Rows that share an id or have none, copies among them, in the order of keys."""
    r = random.Random(seed)
    texts = repetitive(seed, 18)
    rows = [(r.choice([1, 2, 2, 7, None, (1 << 63) - 1]), t) for t in texts] + [(2, texts[0]), (2, texts[0]), (None, texts[1]), (None, texts[1]), (7, None)]
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest()))


def test_every_row_of_an_id_has_its_repeats(spark):
    rows = repeated_ids(5)
    wanted = brute_repeats([(k, t) for k, (_, t) in enumerate(rows)])
    mixed = random.Random(1).sample(rows, len(rows))
    got = suffix.digests(suffix.remove_repeats(frame(spark, mixed).repartition(4), every_row=True)).collect()
    by_text = lambda x: (str(x[0]), *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=by_text) == sorted(((i, *wanted[k]) for k, (i, _) in enumerate(rows)), key=by_text)


def test_every_row_of_an_id_has_its_fingerprints(spark):
    rows = repeated_ids(6)
    got = fingerprints.fingerprint_edits(frame(spark, random.Random(1).sample(rows, len(rows))), every_row=True).collect()
    known = [x for x in rows if x[0] is not None][::-1]
    wanted = [(i, t or "", known[(k + 1) % len(known)][1] or "") for k, (i, t) in enumerate(known)] + [(None, t or "", "") for i, t in rows if i is None]
    edited = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(i), len(t), edited(t, n)) for i, t, n in wanted)
    texts = dict(enumerate(sorted({t or "" for _, t in rows})))
    plain = {texts[r.doc_id]: r.fingerprint for r in fingerprints.fingerprint_edits(frame(spark, list(texts.items()))).collect()}
    assert collections.Counter(r.fingerprint for r in got) == collections.Counter(plain[t or ""] for _, t in rows)


def test_pipeline_keeps_rows_that_share_an_id(spark):
    import corpus_pipeline

    rows = repeated_ids(7)
    docs = spark.createDataFrame([(i, t, f"l{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n_chars int")
    got = corpus_pipeline.unrepeated(spark, docs.repartition(4), "").collect()
    assert sorted(r.lang for r in got) == sorted(f"l{k}" for k in range(len(rows)))
    for r in got:
        i, t = rows[int(r.lang[1:])]
        assert r.doc_id == i and r.n_chars == len(r.text) <= len(t or "")
    assert sum(len(r.text) for r in got) < sum(len(t or "") for _, t in rows)
