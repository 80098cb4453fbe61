"""Token counts kept as delta-maintained rollups.

A change is a signed row: +1 for a document's count under a tokenizer version, -1 to
take back one that was given before. A revised count, or another version, is the old
row with -1 and the new row with +1. Totals by source, language and tokenizer are sums
of signed rows, so batches may come in any order and no document table is kept.

A batch is summed by its keys, written beside the others and renamed to its own name.
A name that is there already is a batch that was committed: applying it again does
nothing. ``compact`` folds batches into one base that remembers their names.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossia.llm.batches import added
from glossia.llm.bpe import encoder
from glossia.llm.durable import new_dir

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
#: Tokenizer versions that need no vocabulary: white-space words, and words and single marks.
PATTERNS = {
    "words@1": r"[^\x20\x09-\x0D]+",
    "words@2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}


def counted(docs: DataFrame, versions: tuple[str, ...] = tuple(PATTERNS), vocabularies: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, source, lang`` and one count column for each version; null texts count 0.

    ``vocabularies``: more versions by the path of a tokenizer's JSON file on each
    machine, counted by the encoder of ``bpe``.
    """
    text = F.coalesce("text", F.lit(""))
    columns = ["doc_id", "source", "lang", *[F.regexp_count(text, F.lit(PATTERNS[v])).cast("long").alias(v) for v in versions]]
    for version, path in (vocabularies or {}).items():
        docs = added(docs, "text", f"`{version}` long", lambda path=path: lambda texts: [list(map(len, encoder(path).encode(texts)))])
        columns.append(F.col(f"`{version}`"))
    return docs.select(*columns)


def changes(counts: DataFrame, version: str, sign: int) -> DataFrame:
    """Signed rows that insert (+1) or take back (-1) a version's counts."""
    return counts.select(
        "source", "lang", F.lit(version).alias("tokenizer"), F.lit(sign).alias("sign"), F.col(f"`{version}`").alias("n_tokens")
    )


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, store = _path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def _commit(df: DataFrame, root: str, kind: str, name: str) -> bool:
    """Write beside, then rename: a folder under its name is always whole."""
    spark = df.sparkSession
    target, store = _path(spark, f"{root}/{kind}/{name}")
    if store.exists(target):
        return False
    staged = f"{root}/staged/{new_dir(spark, name).rpartition('/')[2]}"
    df.write.parquet(staged)
    store.mkdirs(target.getParent())
    return _renamed(spark, staged, f"{root}/{kind}/{name}")


def _renamed(spark: SparkSession, staged: str, target: str) -> bool:
    """Give a written folder its name; False if another one has it.

    A folder that gets the name in between takes the staged one inside it, which then
    is taken out again; readers list no folders below a batch.
    """
    (source, store), (to, _) = _path(spark, staged), _path(spark, target)
    if store.rename(source, to):
        inside, _ = _path(spark, f"{target}/{staged.rpartition('/')[2]}")
        if not store.exists(inside):
            return True
        store.delete(inside, True)
        return False
    if not store.exists(to):
        raise OSError(f"{staged} could not be renamed to {target}")
    return False


def _base(spark: SparkSession, root: str) -> tuple[DataFrame | None, set[str]]:
    bases = _names(spark, f"{root}/base")
    if not bases:
        return None, set()
    newest = f"{root}/base/{bases[-1]}"
    names = spark.read.schema("name string").parquet(f"{newest}/batches")
    return spark.read.schema(SCHEMA).parquet(f"{newest}/totals"), {r["name"] for r in names.collect()}


def apply(spark: SparkSession, root: str, batch: str, signed: DataFrame) -> bool:
    """Commit one batch; False if a batch of this name was committed before.

    ``signed``: source, lang, tokenizer, sign, n_tokens. Null keys are keys of their
    own, a null sign or count adds nothing, an empty batch is a batch.
    """
    name = quote(batch, safe="")
    if name in _base(spark, root)[1]:
        return False
    n = F.col("sign") * F.col("n_tokens")
    sums = signed.groupBy(*KEYS).agg(
        F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("tokens")
    )
    return _commit(sums, root, "batch", name)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Sums over all committed batches; keys without documents and tokens are left out."""
    base, folded = _base(spark, root)
    paths = [f"{root}/batch/{n}" for n in _names(spark, f"{root}/batch") if n not in folded]
    parts = [spark.read.schema(SCHEMA).parquet(*paths)] if paths else []
    parts += [base] if base is not None else []
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0))


def compact(spark: SparkSession, root: str) -> None:
    """Fold all committed batches into a new base; older bases and batches may then go."""
    folded = _base(spark, root)[1]
    names = sorted(folded | set(_names(spark, f"{root}/batch")))
    number = f"{len(_names(spark, f'{root}/base')):010d}"
    staged = f"{root}/staged/{new_dir(spark, 'base').rpartition('/')[2]}"
    totals(spark, root).write.parquet(f"{staged}/totals")
    spark.createDataFrame([(n,) for n in names], "name string").write.parquet(f"{staged}/batches")
    target, store = _path(spark, f"{root}/base/{number}")
    store.mkdirs(target.getParent())
    if store.exists(target) or not _renamed(spark, staged, f"{root}/base/{number}"):
        raise OSError(f"another compaction made {target}")
