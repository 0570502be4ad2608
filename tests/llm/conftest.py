import random

import pytest

WORDS = "the of and to in is that it for was on are as with they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


def prose(n, seed=0):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        out += [rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS)]) for _ in range(rng.randint(5, 12))]
        out[-1] += rng.choice([".", ".\n"])
    return " ".join(out[:n])


AWKWARD = [None, "", " ", "\n\n", "one", "two words", "Ünïcödé straße Σίσυφος 漢字 🙂", "tab\tand\x0bvt \x85nel\xa0nbsp", "<|endoftext|> inside", "x" * 5000, "same same same same same same same same same same same same", "line a\nline a\n \nline b\n \nline a", "don't we'll I'm"]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward texts, repeated rows, nulls in every column, and columns with clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1/a", None][i % 3], "x", 1) for i, t in enumerate(AWKWARD)]
    rows += [(100 + i, prose(20 + 7 * i, i), "en", "src0", "y", 2) for i in range(40)]
    rows += [rows[20], rows[20], (None, prose(50, 3), "en", "src0", None, None), (None, None, None, None, None, None), (999, prose(20000, 9), "en", "src0", "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, kept int").repartition(3).cache()
