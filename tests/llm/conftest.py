import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = [f"{a}{b}" for a in ("the", "Of", "and", "ÉTÉ", "ra", "ñu", "zz", "kin") for b in ("", "s", "er", "ly,", ".", "über")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (rnd.choice(WORDS) if rnd.random() < 0.3 else "") for _ in range(n))


def hard_rows(seed=0):
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, copies, near copies, shared passages and lines, a periodic and a long text."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(1, 120)) for _ in range(40)]
    passage, line = prose(rnd, 110), "A line that many documents hold, whatever else"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "one"), (45, "ONE"), (46, "\n"), (47, "a\n\nb\n")]
    rows += [(50 + i, base[3]) for i in range(12)]  # copies
    rows += [(70 + i, base[5 + i] + " " + passage + " " + base[15 + i]) for i in range(6)]
    rows += [(80 + i, base[20 + i] + "\n " + line.upper() + "\t\n" + base[9] + "\n" + line) for i in range(5)]
    for i in range(8):  # near copies, each of the one before
        words = rows[20][1].split() if i == 0 else rows[-1][1].split()
        words[rnd.randrange(len(words))] = "changed"
        rows.append((90 + i, " ".join(words)))
    rows += [(100, "Oneaea " * 300), (101, prose(rnd, 6000)), (102, "x" * 900 + " " + "y" * 450)]
    rows += [(7, base[7]), (7, base[7]), (None, base[8]), (None, "alone " + prose(rnd, 30)), (-5, base[9]), (11, base[12])]
    rows += [(110, "日本 テキスト " * 30), (111, "it's <|endoftext|> 'tis\u0085x  \n y"), (112, passage[:700])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return hard_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With other columns, whose names clash with those that operators use."""
    full = [(t, d, "en", 1, 2, "s", 0.5) for d, t in rows]
    return spark.createDataFrame(full, "text string, doc_id long, lang string, n int, _bucket int, key string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
