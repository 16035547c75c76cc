"""The registered queries: one thin query an operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import byte_bpe, chat, cotraining, debruijn, fingerprints, lexical, minhash, packing, rules, suffix, toxicity, variants, warc
from tidewatch.llm.common import stored, table, work_folder
from tidewatch.workload.registry import query


@query(
    "op1_warc_captures",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
parts AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((v[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM parts""",
)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a capture, read back and assembled; payloads are checked where they are read and left there."""
    folder = work_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html", min_revisit_bytes=0)
    records = stored(warc.read_archives(spark, folder, with_payload=False))
    return warc.page_captures(stored(warc.assemble(records, hops=0))).drop("target_uri")


@query("op5_byte_bpe")
def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the rank file, and what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op7_best_two_fit_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the method finds."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, added_tokens=True)


@query("op10_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from the labelled rows that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_cotrained_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text by both views, learned from the labelled rows that are not held out."""
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _escaped_sql(column: str, breaks: bool = False) -> str:
    """The escaping of the chat template as nested SQL replacements."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return f"replace({out}, chr(10), chr(92) || 'n')" if breaks else out


@query(
    "op4_event_sourced_chat",
    f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s></s>') + 1 + length({_escaped_sql('role', True)}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
)
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings: logged, folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.logged(rows.unionByName(chat.control_conversation(spark)), every_row=True)
    return chat.digests(chat.read_back(chat.render(chat.fold_events(log))))


@query("op6_decision_list_rules")
def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every whole text, the base rules and the learned list."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_multiset_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"), every_row=True)


@query("op2_circulant_minhash")
def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 85 percent of five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op9_run_length_index")
def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that a string of 100 bytes repeats from earlier."""
    return suffix.digests(suffix.remove_repeats(table(spark, sf_dir, "documents"), every_row=True))


# The table of the checksum follows from its polynomial; a word is looked up by itself with one place left out.
@query(
    "op11_prefix_suffix_tiles",
    """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT id, run, n, hex(encode(id || run)) AS x, t FROM counted, crc),
summed AS (SELECT run, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes),
taken AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM taken WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest, length(word) AS m FROM (SELECT word, n, unnest(range(length(word))) AS k FROM w)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.m = b.m AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min({'w': near, 'n': near_n}, {'a': -near_n, 'b': encode(near)}) AS f FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * w.n THEN f.w END AS form, CASE WHEN f.n >= 2 * w.n THEN f.n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last, 0 AS hops FROM formed UNION ALL SELECT c.word, f.form, hops + 1 FROM chain c JOIN formed f ON c.last = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, hops) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
)
def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text, their near words and the forms they go back to."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op12_bit_sliced_search",
    f"""WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS n FROM d GROUP BY doc_id),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, g GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN d USING (term) JOIN l USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
)
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents of highest score for every benchmark item, over all whole texts."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_de_bruijn_spans",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, start, array_to_string(words[start + 1 : start + 20], ' ') AS span FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS start FROM d WHERE len(words) >= 20)),
later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY span ORDER BY doc_id, start) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, start + unnest(range(20)) AS place FROM later),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.place) AS kept FROM t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.place = g.place WHERE g.place IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that a window of 20 words repeats from earlier."""
    return debruijn.digests(debruijn.remove_repeats(table(spark, sf_dir, "documents")))
