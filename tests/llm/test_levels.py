import random

from weft.llm.levels import prose_lines, reading_levels, sentences

EASY = "the cat dog sun sees runs likes has red big".split()
HARD = [f"{a}{b}" for a in ("hydro", "thermo", "socio", "para") for b in ("dynamics", "metric", "genesis", "taxonomy", "static")]


def text(level, rng):
    out = []
    for _ in range(6):
        n = 4 + 5 * level
        out.append(" ".join(rng.choice(HARD if rng.random() < (level - 1) * 0.2 else EASY) for _ in range(n)).capitalize() + ".")
    return " ".join(out)


def test_levels(spark):
    rng = random.Random(4)
    truth = [1 + i % 5 for i in range(600)]
    docs = [(i, text(lv, rng), rng.choice(["en", "EN ", None, "und"]), 1) for i, lv in enumerate(truth)]
    dirt = [(1000, None, "en", 1), (1001, "", None, 1), (1002, "12 34 !!", "en", 1), (1003, "```\ncode here\n```", "en", 1), (None, "The cat.", "en", 1), docs[0], (1004, "- red\n- big cat", None, 1), (1005, "the cat runs. " * 50_000, None, 1)]
    labels = [(i, 1, lv, 1) for i, lv in enumerate(truth) if i % 2 == 0] + [(0, 1, truth[0], 1), (2, 2, None, 1), (4, 3, 77, 1), (None, 1, 3, 1), (5000, 1, 3, 1)]
    found = reading_levels(
        spark.createDataFrame(docs + dirt, "doc_id long, text string, lang string, level int"),
        spark.createDataFrame(labels, "doc_id long, rater int, reading_level int, lang int"),
    )
    got = {r.doc_id: r.level for r in found.collect()}
    assert set(range(600)) <= set(got) and not {1000, 1001, 1002, None} & set(got) and {1004, 1005} <= set(got)
    held = [i for i in range(600) if i % 2]
    assert sum(abs(got[i] - truth[i]) <= 1 for i in held) / len(held) > 0.95
    assert sum((got[i] >= 4) == (truth[i] >= 4) for i in held) / len(held) > 0.85
    assert all(1 <= v <= 5 for v in got.values())


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "The cat sees the dog.", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, rater int, reading_level int")
    assert [(r.doc_id, r.level) for r in reading_levels(docs, labels).collect()] == [(1, None)]
    assert reading_levels(docs.limit(0), labels).count() == 0


def test_prose():
    page = "# Head line\n\nA: The cat runs. It is big!\n- an item.\n| a | b |\n```\nx = 1.\n```\nno end here"
    assert prose_lines(page) == ["The cat runs. It is big!"]
    assert sentences(page) == [["the", "cat", "runs"], ["it", "is", "big"]]
    assert sentences("a, b, c, d, e, f, g. The id 12ab x9 runs.") == [["the", "id", "runs"]]
