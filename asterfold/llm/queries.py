"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), distance=4, shingle=4)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.pieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, length=4096)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.huffman import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from asterfold.llm.topk import top_scores

    return top_scores(_table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


TOP_SCORES = """
with v as (select vec_id, min(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as x from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
     s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
           from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as "rank", vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_pieces, op3_main_text, op4_secrets, op5_packing, op6_token_counts, op7_quality, op8_token_files, op9_nearest, op10_top_scores)}


def oracle_sql() -> dict[str, str]:
    """SQL of those that DuckDB can express. Tokenizers, models and HTML are beyond it; see tests/llm."""
    return {"op10_top_scores": TOP_SCORES}
