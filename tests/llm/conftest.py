import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, th long"
SYLLABLES = {
    "en": ["the", "ing", "er", "ou", "wh", "sh", "and", "tion", "th", "of"],
    "fr": ["eau", "é", "ez", "ou", "qu", "aient", "le", "eux", "ç", "oi"],
    "de": ["sch", "ung", "ä", "ein", "tz", "ich", "der", "ü", "pf", "en"],
}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def rows_of(texts, langs=None):
    """Rows of documents, with extra columns whose names operators use inside."""
    langs = langs or [None] * len(texts)
    return [(i, t, lang, f"s{i % 3}", len(t or ""), -i, "clash", 0) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared lines, nulls, empties and a long one, and their languages."""
    rng = random.Random(5)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(60)]
    texts = [prose(rng, lang, rng.randint(20, 120)) for lang in langs]
    texts = [t.replace(" ", "\n", 1) + "\nThe very same footer line\n" if i % 4 == 0 else t for i, t in enumerate(texts)]
    for i in (1, 2, 3):  # near copies: one word of many differs
        words = texts[i].split(" ")
        for _ in range(2):
            own = list(words)
            own[len(own) // 2] = "changed" + str(rng.random())[2:6]
            texts.append(" ".join(own))
            langs.append(langs[i])
    texts += [texts[5]] * 4 + [None, "", None, "   ", "12 34", "a", prose(rng, "en", 20_000)]
    langs += [langs[5]] * 4 + [None, "en", None, None, "fr", "en", "en"]
    return texts, langs


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = rows_of(*corpus)
    rows += [rows[7], rows[7], (None, "no id\nThe very same footer line", "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
