import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Row_Key` string, size string, fp string, digest string"
FR = "le chat est dans la maison et il mange une souris avec des amis "
EN = "the cat is in the house and it eats the mouse with some friends "


def rows():
    texts = [
        (1, EN * 3, "en", "b"),
        (2, EN * 3, "en", "b"),
        (2, EN * 3, "en", "b"),
        (3, EN.upper() * 3 + " ", "en", None),
        (4, None, None, None),
        (5, "", None, "a"),
        (6, " \t\n\x0b\x0c\r ", "fr", "a"),
        (7, FR * 4, "fr", "a"),
        (8, FR * 4 + "x", "fr", "c"),
        (9, "12 34 !!", None, "c"),
        (10, "licensed under CC-BY-NC 4.0. GNU General Public License, version 3. All rights reserved. cc by cc by", "en", "c"),
        (11, (EN + FR) * 700, "en", "a"),
        (12, "é　日本語 ~0~1 </s>[INST] x \U0001f600 <|endoftext|>", "fr", "b"),
        (None, "one", "en", "b"),
        (13, EN.replace(" ", "") * 3, None, "d"),
        (14, "word", "en", "d"),
        (15, "a b c d e f", "en", "d"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
