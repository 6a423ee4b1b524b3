import random

import public_tokenizers
import pytest
from pyspark.sql import types as T

WORDS = "river stone market garden window paper summer bridge letter candle forest silver engine harbor meadow copper lantern pocket thunder valley".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_bpe():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30000)
    same = prose(rng, 80)
    return [
        (None, None, None, None, None),
        (None, "A text without an id. " * 5, "en", "web", 3),
        (1, "", "en", None, 0),
        (2, None, None, "web", None),
        (3, " \t\n \r\n", "en", "web", 5),
        (4, long, "en", "web", len(long)),
        (5, same, "en", "books", len(same)),
        (5, same, "en", "books", len(same)),
        (6, same, None, "books", len(same)),
        (7, "x", "de", "", 1),
        (8, "ẞ İ ▁ \U0001f600 <|endoftext|> é\u0000 ", "de", "ü", 20),
        (8, "other text, same id", "de", "ü", 20),
        (-9, "12345 6789 !!! ??? ###", "en", "web", 22),
        (10, "ab" * 200000, "de", "web", 400000),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """Columns named as those that operators add or use inside."""
    from pyspark.sql import functions as F

    names = "score lang_pred size taken n_words n_shingles component_id n_tokens start n_lines n_removed fingerprint copies decoded piece_ids prefix_deltas source_size _size _t _id _h _cuts _words _lines _salt node kept n form output labels matches rank weight slice place w0 id gram target"
    return edge.select("*", *[F.lit(7).alias(n) for n in names.split()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
