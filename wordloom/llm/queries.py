"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, codebooks, exact_dedup, fuzzy_lines, langid, merkle, packing, quality_crf, secret_grammar, sharding, simhash, small_world, spotsigs
from wordloom.llm.common import crc_mod, documents, embeddings, pick

SPACES = r"[\x20\x09-\x0D]+"


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP3_SQL = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.held_out_split(documents(spark, sf_dir), folds=5, fold=0)
    model = langid.fit(docs.where("NOT held_out"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), "doc_id", "text")
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality_crf.fit(docs, labels.where(~held))
    found = quality_crf.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_bad_lines")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secret_grammar.scan(docs, secret_grammar.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k) for k in secret_grammar.KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def tokenizer_path() -> str:
    """The published byte-level vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_components(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 16)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(), capacity=1024, end_id=2)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_world.nearest(embeddings(spark, sf_dir), every=20, k=20)


def neighbour_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op11_neighbours: for each query how many neighbours there are, and that each has the score that its vectors have."""
    found = op11_neighbours(spark, sf_dir)
    x = embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    both = found.join(x, "vec_id").join(x.toDF("query_id", "q"), "query_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return both.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_and(product == F.col("score")).alias("exact"), F.max("rank").alias("last"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def _merkle_sql(levels: int = 5) -> str:
    """Unrolled levels: runs of 16 nodes of a tree become one while it has several (t: sources' trees, u: the tree of their roots), and leaves are then folded up along them."""
    size = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(size, ['doc_id', 'source', 'lang', 'n_chars']))} || {size(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32, a byte's eight bits one after the other.
    step = "xor(c, x)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)[1]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, x: {step}), 4294967295)"
    out = f"""WITH base AS MATERIALIZED (
  SELECT coalesce('=' || source, '') AS tree, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, {leaf('text')}) - 1 AS pos FROM documents),
t0 AS MATERIALIZED (SELECT tree, pos, leaf AS h FROM base),"""
    for a, start in (("t", None), ("u", f"t{levels}")):
        if start:
            out += f"\nu0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS source FROM {start}),"
        for k in range(levels):
            out += f"""
{a}{k}_r AS MATERIALIZED (
  SELECT tree, pos // 16 AS up, list(h ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY tree) AS n FROM {a}{k} GROUP BY tree, pos // 16),
{a}{k + 1} AS MATERIALIZED (SELECT tree, up AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {a}{k}_r),"""
    last = "o"
    out += "\no AS (SELECT doc_id, leaf, tree, tree AS source, pos, '' AS proof, changed AS folded FROM base),"
    for a in "tu":
        if a == "u":
            out += f"\nv AS MATERIALIZED (SELECT o.* REPLACE ('' AS tree, s.pos AS pos) FROM {last} o JOIN u0 s USING (source)),"
            last = "v"
        for k in range(levels):
            out += f"""
f{a}{k} AS MATERIALIZED (
  SELECT o.* REPLACE (r.up AS pos, o.proof || array_to_string(list_concat(r.run[1:(o.pos % 16)::INT], r.run[(o.pos % 16)::INT + 2:]), '') AS proof,
    CASE WHEN r.n > 1 THEN sha256(array_to_string(list_concat(r.run[1:(o.pos % 16)::INT], [o.folded], r.run[(o.pos % 16)::INT + 2:]), '')) ELSE o.folded END AS folded)
  FROM {last} o JOIN {a}{k}_r r ON r.tree = o.tree AND r.up = o.pos // 16),"""
            last = f"f{a}{k}"
    return out.rstrip(",") + f"""
SELECT o.doc_id, o.leaf, s.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.h AS verified
FROM {last} o JOIN t{levels} s ON s.tree = o.source, u{levels} r"""


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.vector_codes(embeddings(spark, sf_dir))


def _codebook_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds unrolled: x has a row for each part of each vector, b one for each entry."""
    out = f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM x WHERE id <= {entries}),"""
    near = "arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT id, p, e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {} b USING (p)) GROUP BY id, p"
    for r in range(rounds):
        out += f"""
a{r} AS MATERIALIZED (SELECT id, p, {near.format(f'b{r}')}),
s{r} AS MATERIALIZED (SELECT p, e, i, ((sum(c) - (sum(c) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM (SELECT p, e, unnest(v) AS c, unnest(range(len(v))) AS i FROM x JOIN a{r} USING (id, p)) GROUP BY p, e, i),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM s{r} GROUP BY p, e) n USING (p, e)),"""
    return out + f"""
a AS MATERIALIZED (SELECT id, p, {near.format(f'b{rounds}')}),
c AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (id), h"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1_spotsigs: each text's length and the hash of its edited text."""
    return op1_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first(t) OVER (ORDER BY doc_id, t)) AS after, length(t)::BIGINT AS n_chars FROM d)
SELECT doc_id, n_chars, sha256(substr(t, 1, n_chars - n_chars // 4) || substr(after, 1, n_chars // 4)) AS edited_sha256 FROM n
"""


def letterless_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4_language_id: which texts have no letter, so no language."""
    return op4_language_id(spark, sf_dir).select("doc_id", (F.col("lang_pred") == langid.UNKNOWN).alias("letterless"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_secrets: the number of base matches of each kind."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
SECRETS_SQL = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_EITHER}["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents
"""


def shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8_sharding: sizes, slots without gaps, shards within 2 % of the mean, and equal texts together."""
    from pyspark.sql import Window as W

    rows = op8_sharding(spark, sf_dir)
    per = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), (F.max("slot") + 1 == F.count("*")).alias("gapless"))
    total = per.agg(F.sum("bytes").alias("total"))
    even = per.join(F.broadcast(total), F.lit(True)).select("shard", "gapless", (F.abs(F.col("bytes") * 16 - F.col("total")) <= 0.02 * F.col("total")).alias("even"))
    text = W.partitionBy("size", "text_crc32")
    return rows.join(even, "shard").select("doc_id", "size", "law", "gapless", "even", (F.min("shard").over(text) == F.max("shard").over(text)).alias("together"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9_bpe: decoding gives each text back."""
    return op9_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "op11_neighbours": op11_neighbours,
    "op12_merkle": op12_merkle,
    "op13_codebooks": op13_codebooks,
    "neighbour_queries": neighbour_queries,
    "edited_texts": edited_texts,
    "letterless_texts": letterless_texts,
    "secret_counts": secret_counts,
    "shard_groups": shard_groups,
    "decoded_texts": decoded_texts,
}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op12_merkle": _merkle_sql(),
    "op13_codebooks": _codebook_sql(),
    "neighbour_queries": "SELECT vec_id AS query_id, least(20, count(*) OVER () - 1) AS n, true AS exact, least(20, count(*) OVER () - 1)::INT AS last FROM embeddings QUALIFY vec_id % 20 = 0",
    "edited_texts": EDITED_SQL,
    "letterless_texts": r"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS letterless FROM documents",
    "secret_counts": SECRETS_SQL,
    "shard_groups": "SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, 'bytes' AS law, true AS gapless, true AS even, true AS together FROM documents",
    "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
}
