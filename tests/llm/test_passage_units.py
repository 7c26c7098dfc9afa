import random

from spanveil.llm import passages


def found(spark, rows):
    return {r.doc_id: (r.start, r.end, r.n_words) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_passages_of_short_lines_are_found(spark):
    """Units of under four words weighed nothing, however long the list."""
    menu = "\n".join(f"dish{i} {i % 7} euro" for i in range(60))
    got = found(spark, [(1, menu), (2, "\n".join(f"other{i} 5 euro" for i in range(60))), (3, "A new beginning stands before the list here.\n" + menu)])
    assert set(got) == {3} and got[3][2] > 170


def test_short_lines_that_repeat_apart_stay(spark):
    """All lines of the second text stand somewhere before, never beside the same neighbours."""
    lines = [f"word{i} number {i}" for i in range(80)]
    mixed = lines[:]
    random.Random(1).shuffle(mixed)
    assert found(spark, [(1, "\n".join(lines)), (2, "\n".join(mixed))]) == {}


def test_passage_inside_long_sentences(spark):
    """No sentence is shared, but 120 words in the middle of one are."""
    rng = random.Random(2)
    words = lambda n: " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))
    shared = words(120)
    got = found(spark, [(1, f"{words(20)} {shared} {words(20)}."), (2, f"{words(33)} {shared} {words(9)}."), (3, words(200))])
    assert set(got) == {2} and 90 <= got[2][2] <= 120
