"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import repair
from .leaks import find_leaks
from .mixing import mix
from .neardup import near_duplicates
from .neighbours import close_pairs, nearest
from .overlap import find_overlaps, overlap_report
from .packing import fill_report, pack
from .splits import assign_splits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers f(table) under its name; ``table(name)`` reads a table of the given folder."""
    QUERIES[f.__name__] = lambda spark, folder: f(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
    return f


@query
def p1_found(table) -> DataFrame:
    return assign_splits(table("pairs"), table("split_targets")).where("n_paths > 1").select("pair_id", "group_id")


@query
def p1_splits(table) -> DataFrame:
    return assign_splits(table("pairs"), table("split_targets")).select("pair_id", "group_id", "split")


def leaks(table) -> DataFrame:
    return find_leaks(table("pairs").where("lower(trim(split)) = 'train'"), table("probes"))


@query
def p2_found(table) -> DataFrame:
    return leaks(table).select("pair_id", "probe_id").distinct()


@query
def p2_leaks(table) -> DataFrame:
    return leaks(table)


@query
def p3_found(table) -> DataFrame:
    return find_overlaps(table("pairs")).select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b"))


@query
def p3_report(table) -> DataFrame:
    return overlap_report(find_overlaps(table("pairs")))


@query
def p4_found(table) -> DataFrame:
    return close_pairs(nearest(table("chunks"), least=0.90), table("chunks"))


@query
def p4_neighbours(table) -> DataFrame:
    return nearest(table("chunks"))


@query
def p5_found(table) -> DataFrame:
    return near_duplicates(table("chunks"), "chunk_id", "text", size=3, share=0.5).pairs().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query
def p5_groups(table) -> DataFrame:
    return near_duplicates(table("chunks"), "chunk_id", "text").groups().withColumnRenamed("row_id", "chunk_id")


@query
def p6_pack(table) -> DataFrame:
    return pack(table("documents"), table("capacities"))


@query
def p6_fill(table) -> DataFrame:
    return fill_report(pack(table("documents"), table("capacities")))


@query
def p7_mix(table) -> DataFrame:
    return mix(table("documents"), table("mix_targets")).documents


@query
def p7_shares(table) -> DataFrame:
    return mix(table("documents"), table("mix_targets")).shares


@query
def p8_found(table) -> DataFrame:
    return repair(table("documents")).select("doc_id")


@query
def p8_repaired(table) -> DataFrame:
    return repair(table("documents"))


SQL: dict[str, str] = {
    "p1_found": r"""
        WITH RECURSIVE keyed AS (
            SELECT pair_id,
                nullif(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(lower(nfc_normalize(trim(path, chr(32) || chr(9) || chr(10) || chr(13))))), '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/\.?$', ''), '') AS p,
                CASE WHEN lower(trim(anchor_id)) NOT IN ('', 'none', 'n/a') THEN lower(trim(anchor_id)) END AS a,
                nullif(regexp_replace(trim(regexp_replace(lower(query), '[\s\p{Z}]+', ' ', 'g')), '[?.! ]+$', ''), '') AS q
            FROM pairs),
        edges AS (
            SELECT pair_id AS x, min(pair_id) OVER (PARTITION BY p) AS y FROM keyed WHERE p IS NOT NULL
            UNION SELECT pair_id, min(pair_id) OVER (PARTITION BY a) FROM keyed WHERE a IS NOT NULL
            UNION SELECT pair_id, min(pair_id) OVER (PARTITION BY q) FROM keyed WHERE q IS NOT NULL),
        both_ways AS (SELECT x, y FROM edges WHERE x <> y UNION SELECT y, x FROM edges WHERE x <> y),
        reach(id, root) AS (  -- the least id of a component reaches all of it over larger ids
            SELECT pair_id, pair_id FROM keyed
            UNION
            SELECT b.y, l.root FROM reach l JOIN both_ways b ON b.x = l.id WHERE l.root < b.y),
        label AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
        big AS (SELECT root FROM label JOIN keyed ON id = pair_id GROUP BY root HAVING count(DISTINCT p) > 1)
        SELECT id AS pair_id, root AS group_id FROM label WHERE root IN (SELECT root FROM big)""",
    "p4_found": """
        WITH usable AS (
            SELECT chunk_id, vector::DOUBLE[] AS v FROM chunks
            WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        ranked AS (
            SELECT a.chunk_id AS x, b.chunk_id AS y, list_cosine_similarity(a.v, b.v) AS c,
                row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.chunk_id) AS r
            FROM usable a JOIN usable b ON a.chunk_id <> b.chunk_id)
        SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM ranked WHERE r <= 10 AND c >= 0.90""",
}
