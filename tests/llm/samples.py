"""Small tables for the tests of the corpus operators."""

import random

# Besides the columns of documents, names that the operators use themselves.
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "score double, rid long, _id string, _text string, shard int, n int, tokens long, k0 string, hash long")
LABEL_SCHEMA = "doc_id long, quality int, toxic int, score double"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text) if text is not None else None,
            None, 7, "x", None, 3, None, 1, "k", 5)


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "Tie tie TIE"), row(5, "other text here"),
        row(6, "same words again and again and again"), row(6, "same words again and again and again"),
        row(7, "same words again and again and again"), row(None, "no id at all"), row(None, None),
        row(8, long, None, None), row(9, "é ü ß 漢字 \U0001f600 x", "de", None), row(10, "a" * 5000),
        row(-3, "negative id"), row(2**62, "large id"),
    ]


def prose_rows(n=160, seed=5):
    """Prose with copies, near copies, shared passages and junk."""
    rng = random.Random(seed)
    syllables = "the of an re on ti er ha ed es ou nt st or le".split()

    def words(k):
        return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(k)]

    passage = " ".join(words(60))
    out, texts = [], []
    for i in range(n):
        kind = i % 10
        if kind == 7 and texts:
            text = rng.choice(texts)
        elif kind == 8 and texts:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 9:
            text = " ".join(words(40)) + " " + passage + " " + " ".join(words(30))
        elif kind == 6:
            text = " ".join(w + "%%%" for w in words(50))
        else:
            text = " ".join(words(rng.randint(5, 150))) + "\n" + " ".join(words(20)).title()
        texts.append(text)
        out.append(row(i * 3 + 1, text, rng.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 4}"))
    return out
