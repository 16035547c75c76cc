"""Archives, chats, rules, classifiers and the pipeline on small inputs."""

import base64
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import chat, common, cotraining, queries, rules, samples, toxicity, warc

SMALL = "/root/testdata/sf0.001"


# --- WARC -------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/x", "a\r\nb"), (2, "http://a/y\r\nz", "WARC/1.1\r\nWARC-Type: x\r\n\r\n"), (3, None, ""), (4, "u", "x\r"), (5, "u", "\r\r\n\r\r"),
    (6, "u", "\r\n\r\n"), (7, "http://h?q", "a\r\nb"), (8, "u", None), (9, "u", "é\x00中\n\n"), (10, "u", "\n"), (None, "u", "none"),
    (11, "u", "a" * 100_000 + "\r\r"), (12, "u", "a\r\nb"), (12, "u", "a\r\nb"), (13, "u", "\r" * 70_000), (14, "u", "\r\n" * 70_000),
]


@pytest.mark.parametrize("hops", [0, 1])
def test_captures_round_trip(spark, hops):
    pages = common.prepared(spark) and spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = common.work_folder(spark)
    warc.write_archives(pages, folder, "page_id", "url", "html")
    captures = warc.assemble(warc.read_archives(spark, folder), hops)
    assert captures.where("size(requests) = 1 and size(metadata) = 1").count() == captures.count() == 15
    payloads = {r[0]: (r[2] or "").encode() for r in PAGES}
    first = {}
    for i in sorted(p for p in payloads if p is not None):
        first.setdefault(payloads[i], i)
    for r in warc.page_captures(captures).collect():
        body = payloads[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        main = first.get(body, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if main == r.page_id else ("revisit", main))
    kept = {bytes(r.payload) for r in captures.where("record_type = 'response'").collect()}
    assert kept == set(payloads.values())


def test_small_payloads_are_all_responses(spark):
    folder = common.work_folder(spark)
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archives(pages, folder, "page_id", "url", "html", min_revisit_bytes=3)
    got = {r.page_id: r.refers_to for r in warc.page_captures(warc.assemble(warc.read_archives(spark, folder))).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_records_find_their_response(spark):
    kind = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to_id string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
    row = lambda i, t, to: (i, t, "u", to, None, None, None, {}, None)
    rows = [row("r", "response", ["q"]), row("q", "request", []), row("m", "metadata", ["q"]), row("lost", "metadata", ["none"]), row("q", "request", [])]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, kind)).collect()}
    assert {x.record_id for x in got["r"].requests} == {"q"} and {x.record_id for x in got["r"].metadata} == {"m"}
    assert got["none"].record_type is None and [x.record_id for x in got["none"].metadata] == ["lost"]


def test_empty_archive(spark):
    folder = common.work_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder, "page_id", "url", "html")
    assert warc.assemble(warc.read_archives(spark, folder)).count() == 0


# --- chat -------------------------------------------------------------------------------------


def test_events_fold(spark):
    rows = [
        (1, "a", 1, "message", "user", "draft"), (1, "a", 4, "edit", "user", "final"), (1, "b", 2, "delta", "assistant", "bad"),
        (1, "b", 5, "regenerate", None, None), (1, "b", 7, "delta", None, "lo"), (1, "b", 6, "delta", None, "hel"), (1, "b", 6, "delta", None, "hel"),
        (1, "c", 8, "message", "user", "gone"), (1, "c", 9, "retract", None, None), (2, "a", 1, "delta", "assistant", None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, message_id string, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert got == {(1, "a"): ("user", "final"), (1, "b"): ("assistant", "hello"), (2, "a"): ("assistant", "")}


def test_control_strings_survive(spark):
    r = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "\n", "é", "[", "/", "<", "INST]", "s>", " "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a\nb", None]), "".join(r.choice(parts) for _ in range(r.randint(0, 12))) or None) for c in range(30) for t in range(4)]
    rows += [(99, 0, "user", "x" * 3000), (99, 1, "assistant", "y\\" * 2000), (98, None, "user", "t"), (97, 0, "user", "same"), (97, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold_events(chat.logged(table)))
    read = {x.conv_id: x for x in chat.read_back(rendered).collect()}
    wanted = collections.defaultdict(list)
    for c, t, role, text in sorted(set(rows), key=lambda x: (x[0], -1 if x[1] is None else x[1])):
        wanted[c].append((role or "", text or ""))
    assert {c: [(t.role, t.text) for t in x.turns] for c, x in read.items()} == wanted
    assert {c: x.loss_texts for c, x in read.items()} == {c: [t for role, t in v if role == "assistant"] for c, v in wanted.items()}
    for x in rendered.collect():
        assert x.formatted.count("</s>") == len(wanted[x.conv_id])
    assert chat.render(chat.fold_events(chat.logged(table.limit(0)))).count() == 0


def test_chat_query_has_the_control_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    row = queries.chat_query(spark, SMALL).where("conv_id = -7").first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_repeated_turns_are_messages_each(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql

    rows = [(1, 0, "user", "hi")] * 3 + [(1, 1, "assistant", "y" * 600)] * 2 + [(1, 3, "assistant", "z" * 300)] * 2 + [(2, 4, None, None), (2, 4, None, None), (2, 5, "user", "x"), (3, None, "user", "b"), (3, -1, "user", "a\n"), (3, None, "b\n\\", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.chat_query(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    relation = connection.sql(oracle_sql()["op4_event_sourced_chat"])
    assert sorted(map(tuple, got.select(*relation.columns).collect())) == sorted(relation.fetchall())
    assert {r.conv_id: r.n_turns for r in got.collect()} == {1: 7, 2: 3, 3: 3, -7: 2}


def test_long_roles_null_turns_and_clashing_columns(spark):
    roles = ["r" * 100_000, "\n" * 100_000, "\\" * 99_999 + "\n", "\\n\n\\", "a\\\\n</s><|[INST]\n", "n", ""]
    rows = [(1, k, role, f"text {k}") for k, role in enumerate(roles)] + [(2, None, "user", "b"), (2, -1, "user", "a"), (2, 1, "assistant", "z" * 300_000), (2, None, "assistant", "c")]
    table = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, seq long, copies long, formatted string, e long")
    read = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(chat.render(chat.fold_events(chat.logged(table, every_row=True)))).collect()}
    assert read[1] == [(role, f"text {k}") for k, role in enumerate(roles)]
    assert read[2] == [("user", "a"), ("assistant", "z" * 300_000), ("assistant", "c"), ("user", "b")]


# --- rules ------------------------------------------------------------------------------------


def brute_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered.update((k, k + 1, k + 2))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t", "a", "a b c a b c", "a a a a a", "x\n\nx\n \nx", "  a b", "é|# $ <>\x0b\x0cz"]
    texts += ["".join(r.choice(["a", "b", "c d", " ", "\n", "#", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:6] for x in rules.statistics(docs, "doc_id").collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_rules_cover_and_prune(spark):
    r = random.Random(5)
    rows = []
    for i in range(900):
        symbols, upper = r.random(), r.random()
        rows.append((int(symbols > 0.8 or (upper > 0.7 and symbols < 0.3)), 100.0, 5.0, symbols, 0.0, 0.0, upper, 0.0, i % 3 != 0))
    names = ", ".join(f"{n} double" for n in rules.FEATURES)
    table = spark.createDataFrame(rows, f"bad int, {names}, grows boolean")
    found = rules.learn(table)
    assert 1 < len(found) <= rules.MOST_RULES
    right = table.withColumn("kept", rules.verdict(found)).where("kept = (bad = 0)").count()
    assert right > 0.93 * len(rows)


def test_no_labels_no_rules(spark):
    docs = spark.createDataFrame([(1, "w " * 60), (None, None), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(docs, labels).collect()}
    assert got == {1: (True, False), None: (True, False), 2: (True, False)}


# --- classifiers ------------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [r.choice(["the", "and", "house", "tree", "water", "stone", "light"]) for _ in range(60)]
        if toxic:
            for k in r.sample(range(60), 6):
                words[k] = r.choice(["zorgle", "blargus", "BLARGUS!", "z0rgle"])
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 7}", 300, 1.0))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s1", 0, None), (None, "plain words", "en", "s", 11, None), (3, rows[3][1], "en", "s3", 300, 2.0)]
    labels += [(1000, None, None), (None, 1, 0), (3, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    return docs.withColumn("label", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cotrained_views(spark):
    docs, labels = labelled(spark)
    got = cotraining.score(docs, labels).toPandas()
    assert len(got) == 404 and got.score.between(0, 1).all()
    known = got.merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id").dropna(subset=["quality"])
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert not got[got.doc_id.isin([1000, 1001])].kept.any()
    none = cotraining.score(docs, labels.limit(0))
    assert none.where("kept").count() == 402


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == 404 and got.score.between(0, 1).all()
    known = got.merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id").dropna(subset=["toxic"])
    held = known[known.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert set(toxicity.score(docs, labels.limit(0)).toPandas().score) == {0.5}


# --- pipeline ---------------------------------------------------------------------------------


def test_stages_decide(spark):
    docs = common.table(spark, SMALL, "documents").withColumn("Kept_by", F.lit(1)).withColumn("score", F.lit(2))
    columns, counts = docs.columns, [docs.count()]
    folder = common.work_folder(spark)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            from tidewatch.llm import minhash

            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if name == "repeats":
            from test_text_operators import brute_repeats

            before = spark.read.parquet(f"{folder}/{number - 1}").select("doc_id", "text").orderBy("doc_id").collect()
            wanted = brute_repeats([(r.doc_id, r.text) for r in before])
            left = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
            assert all(0 <= wanted[i][0] - wanted[i][1] - n <= 8 * wanted[i][2] for i, n in left.items())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "repeats", "packing"]


def test_near_dedup_links_at_eighty_percent(spark):
    def text(name, changed):
        return " ".join([f"{name}{k}" for k in range(49 - changed)] + [f"{name}x{k}" for k in range(changed)])

    # 45 shingles: with 5 of them changed the similarity is 40 / 50, with 4 it is 41 / 49, with 6 it is 39 / 51.
    rows = [(1, text("a", 0)), (2, text("a", 5)), (3, text("b", 0)), (4, text("b", 4)), (5, text("c", 0)), (6, text("c", 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, SMALL).collect()) == [1, 3, 5, 6]


def test_samples_have_one_row_an_id(spark, monkeypatch):
    docs, labels = labelled(spark)
    row = docs.where("doc_id = 7").first()
    unlabelled = labels.where("doc_id NOT IN (8, 1000)")
    more = [(i, f"{row.text} {k:03d}", "en", "s", 300, 1.0) for i in (7, 8) for k in range(200)]
    docs = docs.drop("label").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, score double"))
    sizes = []
    collected = cotraining._collected
    monkeypatch.setattr(cotraining, "_collected", lambda sample: sizes.append(sample.count()) or collected(sample))
    assert cotraining.score(docs, unlabelled).count() == 804
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert len(sizes) == 2 and sum(sizes) <= ids
    sample = samples.labelled_docs(docs.select("doc_id", "text"), labels, "toxic", 12_000)
    assert sample.count() == sample.select("doc_id").distinct().count() == 400
    assert sample.where("doc_id = 7").first().text == min([row.text, *(t for i, t, *_ in more if i == 7)])
