"""The registered queries of this package, with SQL that must agree where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.llm import attention, brown, fingerprints, jaccard, merkle, mixing, packing, phrases, quality, sharding, substrings, toxicity, warczip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(mod: int, id: str = "doc_id"):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % mod


# --- 1: sharding ------------------------------------------------------------------------------


@_query
def op1_stratified_shards(spark, folder):
    placed = sharding.stratified_shards(_table(spark, folder, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


# --- 2: quality rules -------------------------------------------------------------------------


@_query
def op2_quality_rules(spark, folder):
    docs = _table(spark, folder, "documents")
    model = quality.train(docs, _table(spark, folder, "labels"))
    return quality.rate_documents(docs, model)


# --- 7: toxicity ------------------------------------------------------------------------------


@_query
def op7_toxicity(spark, folder):
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"), where=id_remainder(3) != 1)
    scored = toxicity.score_documents(docs, model)
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


# --- 9: mixing --------------------------------------------------------------------------------


@_query
def op9_fair_mix(spark, folder):
    docs, served = mixing.fair_queue(_table(spark, folder, "documents"))
    taken = served.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("finish").alias("first_finish"))
    return docs.join(taken, "row", "left").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
    )


SQL["op9_fair_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('23|' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS most, 3 * source_size / weight AS ratio FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ordered
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(weight * coalesce(
    (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1), 0), most::DOUBLE) AS target
  FROM ordered
), queued AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (greatest(0, floor(least(done::DOUBLE, target) - (done - size)))
      + greatest(0, floor(least((done + source_size)::DOUBLE, target) - (done + source_size - size)))
      + greatest(0, floor(least((done + 2 * source_size)::DOUBLE, target) - (done + 2 * source_size - size))))::BIGINT AS taken
FROM queued"""


# --- 10: WARC ---------------------------------------------------------------------------------


@_query
def op10_zipped_warc(spark, folder):
    pages = _table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    back = warczip.archive_round_trip(pages, least=0)
    return back.select(
        F.when(F.col("record_id") != "None", F.col("record_id")).cast(kind).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL["op10_zipped_warc"] = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
         list_aggregate(list_transform(range(32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
             ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT]),
           'string_agg', '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id OR page_id IS NULL THEN first END AS refers_to
FROM named"""


# --- 4: fingerprints --------------------------------------------------------------------------


@_query
def op4_simhash(spark, folder):
    return fingerprints.edited_fingerprints(_table(spark, folder, "documents"))


# --- 5: packing -------------------------------------------------------------------------------


def tokenizer_file() -> str:
    """Where this machine keeps the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op5_hilbert_packing(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_file())


# --- 6: substring dedup -----------------------------------------------------------------------


@_query
def op6_suffix_trees(spark, folder):
    cut = substrings.deduplicated(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op6_suffix_trees"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM docs WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS body FROM starts
), repeated AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY body) AS owner FROM windows
), gone AS (
  SELECT DISTINCT doc_id, i + j AS spot FROM repeated, (SELECT unnest(range(13)) AS j) WHERE owner < doc_id
), lists AS (
  SELECT doc_id, list(spot) AS gone FROM gone GROUP BY doc_id
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM docs
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.spot) AS kept
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.spot = g.spot WHERE g.spot IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(l.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""


# --- 3: n-gram Jaccard join -------------------------------------------------------------------


@_query
def op3_chosen_path(spark, folder):
    return jaccard.near_groups(_table(spark, folder, "documents"))


SQL["op3_chosen_path"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))
    ELSE [md5(array_to_string(w, ' '))] END)) AS token
  FROM docs WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * common >= 4 * (x.n + y.n)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), roots AS (
  SELECT node, min(root) AS class_id FROM reach GROUP BY node
), names AS (
  SELECT doc_id, md5(string_agg(token, ' ' ORDER BY token)) AS name FROM sets GROUP BY doc_id
), same AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY name) AS copy_of FROM names
)
SELECT d.doc_id, r.class_id, coalesce(s.copy_of, d.doc_id) AS copy_of, count(l.b) AS n_links
FROM documents d JOIN roots r ON r.node = d.doc_id LEFT JOIN same s ON s.doc_id = d.doc_id LEFT JOIN links l ON l.a = d.doc_id
GROUP BY ALL"""


# --- 8: language-model scores -----------------------------------------------------------------


@_query
def op8_brown_classes(spark, folder):
    return brown.score_documents(_table(spark, folder, "documents"), id_remainder(10) != 0)


# --- 11: Merkle manifest ----------------------------------------------------------------------


@_query
def op11_merkle_manifest(spark, folder):
    docs = _table(spark, folder, "documents")
    proved = merkle.manifest(docs, {"text": merkle.lower_ascii(docs["text"])}, id_remainder(3) == 0, proofs=False)
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digest_sql(text: str) -> str:
    """A row's digest in SQL, with ``text`` as its text."""
    named = [("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"), ("text", text)]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for _, v in named) + ")"


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), hashed AS (
  SELECT doc_id, lang, {_digest_sql("text")} AS leaf, {_digest_sql(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS other,
         xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc_table
), trees AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS m FROM hashed GROUP BY lang
), leaves AS (
  SELECT h.doc_id, h.leaf, CASE WHEN crc % 3 = 0 THEN other ELSE leaf END AS now, t.tree, t.m,
         row_number() OVER (PARTITION BY t.tree ORDER BY h.doc_id NULLS FIRST, h.leaf) - 1 AS idx
  FROM hashed h JOIN trees t ON h.lang IS NOT DISTINCT FROM t.lang
), low AS (
  SELECT tree, 0 AS level, idx, leaf AS node, m FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (m + 7) // 8
  FROM low WHERE m > 1 GROUP BY tree, level, idx // 8, m
), subroots AS (
  SELECT tree, node AS subroot, level AS height, count(*) OVER () AS m FROM low WHERE m = 1
), high AS (
  SELECT 0 AS level, tree AS idx, subroot AS node, m FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (m + 7) // 8 FROM high WHERE m > 1 GROUP BY level, idx // 8, m
), runs AS (
  SELECT tree, level, idx // 8 AS idx, list(node ORDER BY idx) AS nodes FROM low WHERE m > 1 GROUP BY tree, level, idx // 8
), tops AS (
  SELECT level, idx // 8 AS idx, list(node ORDER BY idx) AS nodes FROM high WHERE m > 1 GROUP BY level, idx // 8
), steps AS (
  SELECT l.tree, l.idx, r.level + 1 AS k, (l.idx // pow(8, r.level)::BIGINT) % 8 AS place, r.nodes
  FROM leaves l JOIN runs r ON r.tree = l.tree AND r.idx = l.idx // pow(8, r.level + 1)::BIGINT
  UNION ALL
  SELECT l.tree, l.idx, s.height + r.level + 1, (l.tree // pow(8, r.level)::BIGINT) % 8, r.nodes
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN tops r ON r.idx = l.tree // pow(8, r.level + 1)::BIGINT
), sided AS (
  SELECT tree, idx, k, array_to_string(nodes[1:place], '') AS before, array_to_string(nodes[place + 2:], '') AS after FROM steps
), folds AS (
  SELECT tree, idx, 0::BIGINT AS k, now AS node FROM leaves
  UNION ALL
  SELECT f.tree, f.idx, f.k + 1, sha256(s.before || f.node || s.after)
  FROM folds f JOIN sided s ON s.tree = f.tree AND s.idx = f.idx AND s.k = f.k + 1
), folded AS (
  SELECT tree, idx, arg_max(node, k) AS folded_root FROM folds GROUP BY tree, idx
), proofs AS (
  SELECT tree, idx, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM sided GROUP BY tree, idx
)
SELECT l.doc_id, l.leaf, s.subroot, h.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.folded_root, f.folded_root = h.node AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN high h ON h.m = 1
  JOIN folded f ON f.tree = l.tree AND f.idx = l.idx LEFT JOIN proofs p ON p.tree = l.tree AND p.idx = l.idx"""


# --- 12: phrases ------------------------------------------------------------------------------


@_query
def op12_toivonen_phrases(spark, folder):
    return phrases.collocations(_table(spark, folder, "documents"))


SQL["op12_toivonen_phrases"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spans AS (
  SELECT lang, unnest(list_concat(
    list_transform(range(1, len(w) + 1), lambda i: {{'k': 1, 'p': w[i]}}),
    list_transform(range(1, len(w)), lambda i: {{'k': 2, 'p': w[i] || ' ' || w[i + 1]}}),
    list_transform(range(1, len(w) - 1), lambda i: {{'k': 3, 'p': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}}))) AS s
  FROM lists
), counted AS MATERIALIZED (
  SELECT lang, s.k AS k, s.p AS p, count(*) AS f FROM spans GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, p, f, string_split(p, ' ') AS w FROM counted WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, k, p, f AS a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL
  SELECT lang, k, p, f, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE k = 3
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, ((a::HUGEINT * a * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.head AND x.k = c.cut
    JOIN counted y ON y.lang = c.lang AND y.p = c.rest AND y.k = c.k - c.cut
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, p, max(f) AS longer FROM (
    SELECT lang, f, w[1] || ' ' || w[2] AS p FROM candidates WHERE k = 3
    UNION ALL SELECT lang, f, w[2] || ' ' || w[3] FROM candidates WHERE k = 3) GROUP BY lang, p
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.p) AS rank,
         b.p AS phrase, b.a, b.l, b.r, t.n, b.score
  FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.p = b.p
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT * FROM ranked WHERE rank <= 2000"""


# --- 13: quality classifier -------------------------------------------------------------------


@_query
def op13_attention_quality(spark, folder):
    docs = _table(spark, folder, "documents")
    model = attention.train(docs, _table(spark, folder, "labels"), where=id_remainder(5) != 0)
    scored = attention.score_documents(docs, model)
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "n_passages", "top_passage", "top_weight",
    )
