import random

import pytest

#: Columns whose names the operators use inside, and nulls in each.
CLASH = "doc_id long, text string, lang string, source string, block int, segment int, h long, h1 long, p string, anchor long, rep long, component string, shard int, unit long, value string, owner string, edge boolean, _first long, _b int, _gone long, gone long, bucket long, before long, no int, label long, token long, declared string, rest string, k long, best boolean"


def rows_of(texts):
    """Texts as rows with clashing extra columns; ids are places unless (id, text) pairs are given."""
    pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return [(i, t, None if (i or 0) % 3 else "en", None if (i or 0) % 2 else "s", *[None] * (CLASH.count(",") - 3)) for i, t in pairs]


@pytest.fixture(scope="session")
def corpus():
    """Random prose with exact and near copies, shared passages, repeated lines, odd and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["Für", "año", "The", "ÉTÉ", "😀"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), "All rights   reserved by nobody."
    texts = ["", None, " \t\n", "a", "one two three", "One two THREE", "x" * 5000, "\n" * 50, "\x00\x01 nul", prose(3000)]
    for k in range(60):
        parts = [prose(rng.randint(5, 120)) for _ in range(rng.randint(1, 4))]
        if k % 5 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if k % 4 == 0:
            parts.append(line if k % 8 else line.upper() + "\t")
        texts.append("\n".join(parts))
    texts += [texts[12]] * 6 + [texts[30], texts[31].replace(" ", "  ")]
    for k in range(15, 35):
        w = texts[k].split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts.append(passage + " " + passage)
    return texts


@pytest.fixture(scope="session")
def thue_morse():
    """Two different words (and their mirror) that polynomials modulo 2**64 cannot tell apart."""
    words = []
    for n in (1024, 2048):
        bits = [bin(k).count("1") % 2 for k in range(n)]
        words.append(("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)))
    return words


@pytest.fixture(autouse=True)
def freed():
    """What a test's operators hold is freed after it."""
    yield
    from tessera.llm.common import release

    release()


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), CLASH)


@pytest.fixture(scope="session")
def odd():
    """Null ids, repeated rows, and an id with two texts (the greater stays)."""
    return [(None, "lost"), (1, "same same same same"), (1, "same same same same"), (2, "b"), (2, "a"), (3, None), (3, ""), (4, "same same same same")]
