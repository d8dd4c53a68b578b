"""Registered queries of the corpus operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    exact_dedup,
    fill_middle,
    hmm_scoring,
    language,
    line_dedup,
    manifest,
    mixing,
    near_join,
    secret_scan,
    sharding,
    substring_dedup,
    token_files,
)
from tidemark.llm.common import documents, shared_folder

WORD_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    """Place of a public tokenizer's file; the executors find it there too."""
    return str(public_tokenizers.path(name))


@_query(
    "op1_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    keys AS (
      SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''),
        '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    shared AS (
      SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 40
      GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    marked AS (
      SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keys LEFT JOIN shared USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversible line deduplication over all documents."""
    return line_dedup.dedup_lines(documents(spark, sf_dir), with_text=False)


@_query("op2_hmm_scoring")
def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden-Markov scores of all documents, learned outside of the held-out fold."""
    return hmm_scoring.scores(documents(spark, sf_dir))


@_query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through directly addressable files."""
    return token_files.tokenised(documents(spark, sf_dir), tokenizer_path())


@_query("op4_near_join")
def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups and links of all documents."""
    return near_join.near_groups(documents(spark, sf_dir))


@_query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by the combined automaton."""
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    base = [r.kind for r in secret_scan.RULES[:3]]

    def joined(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(one, ",")

    def of(*kinds):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


@_query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned outside of the held-out fold."""
    return language.predictions(documents(spark, sf_dir))


@_query(
    "op7_decontaminate",
    r"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
    items AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM items WHERE len(w) > 0)),
    spots AS (
      SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, n, item_id FROM spots JOIN windows USING (n, gram)),
    covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    docs = documents(spark, sf_dir)
    return decontaminate.digest(decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@_query(
    "op8_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("n_blocks")


@_query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents that bring the sources to their weights."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query(
    "op10_substring_dedup",
    r"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
    grams AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM spots),
    repeated AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM grams WHERE g IN (SELECT g FROM repeated)),
    placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM docs),
    kept AS (
      SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t
      FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(t, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents removed."""
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


@_query("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents in random order, read back from their files."""
    docs, folder = documents(spark, sf_dir), shared_folder(spark)
    sharding.write_shards(docs, folder)
    return sharding.digest(sharding.read_shards(spark, folder, docs.schema))


@_query(
    "op12_fill_middle",
    r"""
    WITH units AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    draws AS (
      SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
    cuts AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
    parts AS (
      SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
        array_to_string(u[b + 1:n], '') AS s FROM cuts)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
      CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                       WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle outputs of all documents, and the texts rebuilt from them."""
    return fill_middle.transformed(documents(spark, sf_dir))


def _merkle_levels(name: str, leaves: str, group: str) -> str:
    """Recursive SQL: the nodes of every level over `leaves(group, pos, digest, n)`."""
    return f"""
    {name}({group}, level, pos, digest, n) AS (
      SELECT {group}, 0, pos, digest, n FROM {leaves}
      UNION ALL
      SELECT {group}, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)),
        CAST(ceil(any_value(n) / 3.0) AS BIGINT)
      FROM {name} WHERE n > 1 GROUP BY {group}, level, pos // 3)"""


def _merkle_siblings(name: str, start: str, nodes: str, key: str, group: str) -> str:
    """Per leaf and level below the top: digests left and right of its ancestor in their run."""
    return f"""
    {name} AS (
      SELECT s.{key}, a.level,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM {start} s JOIN {nodes} a ON a.{group} IS NOT DISTINCT FROM s.{group} AND a.n > 1
          AND a.pos = s.pos // CAST(pow(3, a.level) AS BIGINT)
        JOIN {nodes} b ON b.{group} IS NOT DISTINCT FROM a.{group} AND b.level = a.level AND b.pos // 3 = a.pos // 3
      GROUP BY s.{key}, a.level)"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: crc32 bit by bit over the bytes of doc_id's decimal text.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
    "lambda x: CAST(ord(x) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), "
    "lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"
)

_MERKLE_SQL = f"""
    WITH RECURSIVE rows_ AS (
      SELECT doc_id, source, {_LEAF.replace("{text}", "text")} AS leaf,
        {_LEAF.replace("{text}", "changed")} AS claimed
      FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS changed
            FROM (SELECT *, {_CRC} % 2 = 0 AS even FROM documents))),
    leaves AS (
      SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM rows_),
    {_merkle_levels("nodes", "leaves", "source")},
    tops AS (
      SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, 0 AS g
      FROM nodes WHERE n = 1),
    {_merkle_levels("crowns", "tops", "g")},
    {_merkle_siblings("below", "leaves", "nodes", "doc_id", "source")},
    {_merkle_siblings("above", "tops", "crowns", "source", "g")},
    steps AS (
      SELECT doc_id, level, l, r FROM below
      UNION ALL
      SELECT d.doc_id, 1000 + a.level, a.l, a.r FROM leaves d JOIN above a ON a.source IS NOT DISTINCT FROM d.source),
    way AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS spot, l, r FROM steps),
    proof AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY spot)) AS proof_sha256, max(spot) AS last FROM way GROUP BY doc_id),
    fold(doc_id, spot, d) AS (
      SELECT doc_id, CAST(0 AS BIGINT), claimed FROM leaves
      UNION ALL
      SELECT f.doc_id, w.spot, sha256(w.l || f.d || w.r) FROM fold f JOIN way w ON w.doc_id = f.doc_id AND w.spot = f.spot + 1)
    SELECT doc_id, leaf, tops.digest AS subroot, c.digest AS root,
      coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.d AS folded_root, fold.d = c.digest AS verified
    FROM leaves d JOIN tops ON tops.source IS NOT DISTINCT FROM d.source
      JOIN (SELECT digest FROM crowns WHERE n = 1) c ON true
      LEFT JOIN proof USING (doc_id) JOIN fold USING (doc_id)
    WHERE fold.spot = coalesce(proof.last, 0)
    """


@_query("op13_manifest", _MERKLE_SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proofs of all documents, checked against rows that lost their line ends."""
    docs = documents(spark, sf_dir)
    return manifest.digest(manifest.proofs(docs, manifest.without_line_ends()))
