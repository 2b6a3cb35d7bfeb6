import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words int, found int, check int, bands int"
WORDS = [f"w{i}x" for i in range(400)]


def passage(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 11 + 1)) % 400] for i in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, copies, near copies, repeated rows, clashing extra columns."""
    base = passage(3, 120)
    texts = {
        1: base, 2: base, 3: base + " tail", 4: "", 5: None, 6: "short text", 7: "mail a.b@c.de or +1 (555) 123-4567",
        8: passage(5, 90) + "\n" + passage(3, 60), 9: "naïve café – ünïcode  double  spaces\n\n\ttab " * 30, 10: passage(17, 30000),
        11: "x" * 3000, 12: "4111 1111 1111 1111 at 10.0.0.255 and 1.2.3.400",
    }
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 0 else "s", None, "a", 1, None, 3, None) for k, t in texts.items()]
    rows += [rows[0], (None, base, None, None, None, None, None, None, None, None), (None, None, "en", "s", 1, "b", 2, 2, 2, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder_small():
    return "/root/testdata/sf0.001"
