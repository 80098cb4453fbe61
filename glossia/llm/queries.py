"""The thirteen operators over their whole tables, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossia.llm import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    durable.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import warc

    return warc.archived(spark, table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import langid

    return langid.identified(table(spark, sf_dir, "documents"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import bpe

    docs = table(spark, sf_dir, "documents")
    return bpe.encoded(docs, bpe.default_vocabulary(), keep=["doc_id"], ids=False)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import decontam

    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import sketch

    return sketch.edited(table(spark, sf_dir, "documents"))


def op7_token_count_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, takedown of toxic documents, move of good ones to words@2, and a replay."""
    from pyspark.sql import functions as F

    from glossia.llm import rollup

    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    counts = rollup.counted(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    counts = durable.saved(counts, "counts")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    better = counts.where(~toxic & (F.col("quality") == 1))
    takedown = rollup.changes(counts.where(toxic), "words@1", -1)
    root = durable.new_dir(spark, "rollup")
    rollup.apply(spark, root, "load", rollup.changes(counts, "words@1", 1))
    rollup.apply(spark, root, "takedown", takedown)
    rollup.apply(spark, root, "retokenise", rollup.changes(better, "words@1", -1).unionByName(rollup.changes(better, "words@2", 1)))
    rollup.apply(spark, root, "takedown", takedown)
    return rollup.totals(spark, root)


def op8_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import kdtree

    return kdtree.shard(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import pii

    return pii.found(table(spark, sf_dir, "documents"))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import packing

    return packing.packed(spark, table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are shown as they are, or, where the CRC-32 of the decimal doc_id is even, without line feeds."""
    from pyspark.sql import functions as F

    from glossia.llm import merkle

    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    shown = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.proved(table(spark, sf_dir, "documents"), shown)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import matching

    return matching.pack(spark, table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossia.llm import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_warc_archives": op2_warc_archives,
    "op3_language_id": op3_language_id,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_bottom_k_fingerprints": op6_bottom_k_fingerprints,
    "op7_token_count_rollups": op7_token_count_rollups,
    "op8_kd_tree_shards": op8_kd_tree_shards,
    "op9_personal_data": op9_personal_data,
    "op10_token_packing": op10_token_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: A node's digest with those of its run, ``r`` the rows of the level below by (tree, pos).
_UP = "SELECT tree, pos // 3 AS pos, height, level + 1 AS level, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {0} WHERE level < height GROUP BY tree, pos // 3, height, level"
_TALL = "(SELECT count(*) FROM range(40) p(i) WHERE 3.0 ** i < n)"
_FIELD = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
#: CRC-32 of the decimal doc_id, bit by bit.
_EVEN = """
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda c, x: list_reduce(list_prepend(xor(c, x), CAST(range(8) AS BIGINT[])), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(3988292384, b >> 1) ELSE b >> 1 END)) % 2 = 1
"""
_FOLD = """
    f{n} AS (
        SELECT doc_id, tree, pos, 0 AS level, height, shown AS own, '' AS proof FROM {start}
        UNION ALL
        SELECT f.doc_id, f.tree, f.pos // 3, f.level + 1, f.height, sha256(coalesce(s.a, '') || f.own || coalesce(s.b, '')), f.proof || coalesce(s.a, '') || coalesce(s.b, '')
        FROM f{n} f JOIN sib{n} s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos WHERE f.level < f.height
    )
"""
_SIBLINGS = "sib{0} AS (SELECT x.tree, x.level, x.pos, string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos) AS a, string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos) AS b FROM t{0} x JOIN t{0} y ON x.tree = y.tree AND x.level = y.level AND x.pos // 3 = y.pos // 3 GROUP BY x.tree, x.level, x.pos)"

#: The others can't be said in SQL on whole tables; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op7_token_count_rollups": r"""
        WITH l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
        d AS (
            SELECT source, lang, coalesce(text, '') AS text, coalesce(quality, 0) = 1 AS better
            FROM documents LEFT JOIN l USING (doc_id)
            WHERE coalesce(toxic, 0) <> 1
        )
        SELECT source, lang, CASE WHEN better THEN 'words@2' ELSE 'words@1' END AS tokenizer,
            count(*) AS documents,
            CAST(sum(CASE WHEN better THEN len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))
                ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END) AS BIGINT) AS tokens
        FROM d GROUP BY ALL
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF('text')} AS leaf,
                CASE WHEN {_EVEN} THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF('text')} END AS shown
            FROM documents
        ), n1 AS (SELECT tree, {_TALL} AS height FROM (SELECT tree, count(*) AS n FROM d GROUP BY tree)),
        leaves AS (SELECT d.*, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, height FROM d JOIN n1 USING (tree)),
        t1 AS (SELECT tree, pos, height, 0 AS level, leaf AS h FROM leaves UNION ALL {_UP.format('t1')}),
        subs AS (SELECT tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t1 WHERE level = height),
        t2 AS (SELECT '' AS tree, pos, {_TALL} AS height, 0 AS level, h FROM subs, (SELECT count(*) AS n FROM subs) UNION ALL {_UP.format('t2')}),
        {_SIBLINGS.format(1)}, {_SIBLINGS.format(2)},
        {_FOLD.format(n=1, start='leaves')},
        up AS (SELECT f1.doc_id, '' AS tree, s.pos, (SELECT max(level) FROM t2) AS height, f1.own AS shown, f1.proof AS near, s.h AS subroot, f1.tree AS source FROM f1 JOIN subs s ON s.source = f1.tree WHERE f1.level = f1.height),
        {_FOLD.format(n=2, start='up')},
        r AS (SELECT h AS root FROM t2 WHERE level = height)
        SELECT l.doc_id, l.leaf, up.subroot, r.root, sha256(up.near || f2.proof) AS proof_sha256, f2.own AS folded_root, f2.own = r.root AS verified
        FROM leaves l JOIN up USING (doc_id) JOIN f2 USING (doc_id), r WHERE f2.level = f2.height
    """,
    "op13_phrase_collocations": r"""
        WITH p AS (
            SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')), '[ \t]+'), lambda x: x <> '') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL)
        ), n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (
            SELECT c.lang, c.k, c.phrase, c.w, a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
            FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
        ), h AS (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM s WHERE k > 2), hh AS (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM h),
        longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM hh GROUP BY ALL)
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase,
            CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM s LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase WHERE most IS NULL OR 100 * most < 100 * a
        QUALIFY rank <= 2000
    """,
}
