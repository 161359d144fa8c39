"""Small document tables with every odd case."""

import random

WORDS = [a + b for a in "ba ke li mo nu ta re so".split() for b in "den rik sal tov wim pex".split()]


def prose(dice, count):
    return " ".join(dice.choice(WORDS) for _ in range(count))


def odd_texts():
    return [
        None, "", " \t\n", "one", "one two", "\n\n", "a" * 5000, "x " * 4000, "é ñ 漢字 \U0001F600 words",
        "line\n\nline\nline", "0" * 3000, "@" * 500, "<p>", "same text here", "same text here",
    ]


def documents(spark, rows):
    """(doc_id, text[, source]) with extra columns that operators use names like."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, "mine", 1, True, "x") for r in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, node string, n int, "
              "kept boolean, label string")


def odd_documents(spark):
    rows = [(i, t, ["a", None, "b"][i % 3]) for i, t in enumerate(odd_texts())]
    rows += [(3, "one", "a"), (3, "one", "a"), (None, "no id", None), (None, None, "b")]
    return documents(spark, rows)


def empty_documents(spark):
    return documents(spark, [])


def corpus(seed=1, count=60):
    """Originals, exact and near copies, short and long texts; ids out of order."""
    dice = random.Random(seed)
    texts = []
    for i in range(count):
        kind = dice.random()
        if texts and kind < 0.2:
            texts.append(dice.choice(texts))
        elif texts and kind < 0.6:
            words = dice.choice(texts).split(" ")
            for _ in range(max(1, len(words) // dice.choice([8, 20, 60]))):
                words[dice.randrange(len(words))] = dice.choice(WORDS)
            texts.append(" ".join(words))
        else:
            lines = [prose(dice, dice.randrange(1, 40)) for _ in range(dice.randrange(1, 6))]
            texts.append("\n".join(lines))
    ids = list(range(0, 3 * count, 3))
    dice.shuffle(ids)
    return list(zip(ids, texts))
