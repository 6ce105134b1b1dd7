import pytest

SCHEMA = "shipment_id long, delivery_hub string, pickup_hub string, goods_type string, n_lines long, `key` string, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Shipments from (id, text) pairs, with columns whose names clash with results."""

    def build(rows, hubs=None):
        full = [(i, t, None if hubs is None else hubs[n], "fmcg" if n % 3 else None, 7, "x", "y") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return build


LINE = "Handle this crate with care, signed by the hub"
PARAGRAPH = " ".join(f"word{i * 7 % 61}x{i % 13}" for i in range(220))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, blanks, repeated rows, ties, copies, a null id, non-ASCII and a long text."""
    return [
        (1, None), (2, ""), (3, " \t\n \n"), (4, LINE), (5, f"  {LINE.upper()}\t\nother text\n{LINE}"), (6, f"{LINE}\nend"),
        (6, f"{LINE}\nend"), (7, PARAGRAPH), (8, PARAGRAPH), (9, f"Straße {PARAGRAPH} Ende"), (10, "größer als ß " * 40),
        (11, "long text " * 60_000), (12, PARAGRAPH[:500] + " tail " + PARAGRAPH[700:]), (13, "you idiot"), (None, PARAGRAPH), (None, None),
        (14, "four words are here"), (15, "four words are here"), (16, "aaaa" * 300),
    ]
