import pytest

pytest.importorskip("riskweave.llm")


@pytest.fixture
def docs(spark):
    """Nulls, empty and very long texts, repeated rows and copies, and an extra column that clashes with names in use."""
    long = " ".join(f"word{i % 977} idiot" if i % 50 == 0 else f"word{i % 977}" for i in range(30_000))
    texts = {
        1: "the quick brown fox jumps over the lazy dog near the river bank today", 2: "the quick brown fox jumps over the lazy dog near the river bank today", 3: "", 4: None, 5: "   \n\t ", 6: "One", 7: long, 8: long + " tail",
        9: "mail bob.smith@mail.example.com or BOB.SMITH@MAIL.EXAMPLE.COM, call +1 (212) 555-0199", 10: "ünïcödé 漢字 🙂 text with   spaces\r\nand lines", 11: "you idiot moron", 12: "x" * 5_000,
    }
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), f"fp{i}") for i, t in texts.items()]
    rows += [rows[0], (None, "no id here", None, None, 10, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 1, 1), (8, 1, 1), (11, 0, 1), (10, 1, 0), (99, 1, 1), (12, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture
def none(docs):
    return docs.limit(0)
