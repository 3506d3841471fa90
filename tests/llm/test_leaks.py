import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import leaks


def distance(piece, text):
    """Least edit distance of piece to any part of text."""
    row = list(range(len(piece) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(piece):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=9), st.text("abc ", max_size=20), st.integers(0, 3))
def test_bit_parallel_distance(piece, text, edits):
    assert leaks._occurs(piece, text, edits) == (distance(piece, text) <= edits)


def test_copies_with_typing_errors(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 9))) for _ in range(400)]
    item = [r.choice(words) for _ in range(40)]
    typos = [w[:2] + ("x" if w[2] != "x" else "y") + w[3:] if i % 7 == 3 else w for i, w in enumerate(item)]
    other = [r.choice(words) for _ in range(200)]
    docs = [(1, " ".join(other[:80] + typos + other[80:])), (2, " ".join(other)), (3, " ".join(item)), (4, None), (5, ""), (6, " ".join(item[:9] + other))]
    run = lambda k: {(x["doc_id"], x["covered_words"]) for x in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"), edits=k).collect()}
    assert run(0) == {(3, 40)} and run(2) == {(1, 40), (3, 40)}
