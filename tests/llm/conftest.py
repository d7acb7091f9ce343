import random

import pytest
from hypothesis import settings

settings.register_profile("steady", deadline=None, derandomize=True)
settings.load_profile("steady")

SF = "/root/testdata/sf0.001"
_WORDS = {
    "en": "the and of to in that is was for on with this from they have been which their would there".split(),
    "fr": "les des une que dans pour qui sur est pas avec son plus elle tout mais nous comme sans leur".split(),
    "de": "der die und den von das mit sich des auf nicht ein eine als auch werden aus nach wird bei".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(_WORDS[lang]) + rng.choice(["", "", "s", "t"]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


#: Names that operators use inside or return.
CLASHING = ("size", "score", "row", "row_hash", "text_hash", "n_words", "key", "class_id", "n_links", "p", "draw", "block", "blocks", "label", "features", "root", "cid", "d1", "t", "w", "h", "kept", "target", "times", "languages", "held_out", "own_id", "stay_id", "runs", "item_ids", "bucket", "level", "words")


def edge_rows():
    rng = random.Random(7)
    long_ = sentence(rng, "en", 40_000)
    same = sentence(rng, "fr", 60)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long_, "en", "b"), (5, same, "fr", "b"), (5, same, "fr", "b"), (6, same, "fr", None), (7, same + " fin", "fr", "c"),
        (None, same, "fr", "c"), (None, None, None, None), (8, "é", "fr", "a"), (8, "two texts, one id", "en", "a"), (9, "a", "en", "a"), (10, "...!!!###", "en", "a"), (11, "line\nline\nline\n" * 30, "en", "a"),
        (12, "\x00 odd \x1c control ​ signs \U0001f600 <|endoftext|>", "en", "a"), (-3, sentence(rng, "de", 80), "de", "a"), (2**62, sentence(rng, "de", 80), "de", "a"),
    ]
    rows += [(100 + i, sentence(rng, lang, 30 + i), lang, rng.choice("abc")) for i, lang in enumerate(["en", "fr", "de"] * 10)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls, empty and long texts, repeated rows, ids of several texts, and columns with clashing names."""
    rows = [(*r, *["x"] * len(CLASHING)) for r in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHING)).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(i, i % 2, i % 3 % 2) for i in range(100, 130)] + [(None, 1, 1), (1, None, 1), (2, 0, None), (100, 1, 0), (999, 1, 1), (4, 7, 7)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
