import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


def prose(rng, n):
    syllables = ["an", "the", "ou", "ing", "er", "re", "st", "é", "ö", "Th", "ND"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows(seed=3, count=160):
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeats."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(count // 2)]
    texts = []
    for i in range(count):
        text = base[i % len(base)] if i % 5 == 0 else prose(rng, rng.randint(1, 150))
        if i % 7 == 0:
            text = text + "\n" + passage + "\n" + prose(rng, 9)
        if i % 11 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 13 == 0:
            text = "same line\n \n" + text + "\nsame line\tagain\nsame line"
        texts.append(text)
    texts[3], texts[4], texts[8], texts[9], texts[10] = None, "", " \t\n", None, ""
    texts[20] = prose(rng, 9_000) + " " + passage
    texts[21] = texts[20]
    texts[22] = "a " * 300
    texts[23] = "x" * 40_000
    texts[24] = "THE!! ### $$$ || <b> " * 30
    texts[25] = "一二 三四 五 六 \x0b七\x1f八"
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4 if i % 3 else 0}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (30, "another text of the same id", "en", "s1", 3)]
    rows += [(None, texts[12], "en", "s1", None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Also with a column whose name the operators use inside."""
    return spark.createDataFrame([(*r, "kept") for r in rows], SCHEMA.format("key")).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA.format("shard"))
