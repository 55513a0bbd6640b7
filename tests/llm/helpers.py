"""Small documents with every defined case, and plain versions of what the operators compute."""

import hashlib
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(n=60, seed=1):
    """(doc_id, text, lang, source, __digest): copies, near copies, hot texts, blanks, nulls, odd spaces, a long text."""
    r = random.Random(seed)
    vocab = {"en": ["the", "house", "water", "green", "thing", "with", "under", "shining"], "es": ["niño", "casa", "agua", "verde", "cosa", "señor", "cuando", "ñandú"]}
    make = lambda lang, k: " ".join(r.choice(vocab[lang]) + r.choice(["", "", "s", "er"]) for _ in range(k))
    rows = []
    base = make("en", 120)
    for i in range(n):
        lang = "es" if i % 3 == 0 else "en"
        kind = i % 10
        if kind == 1:
            text = base
        elif kind == 2:
            w = base.split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = base.replace(" ", "\n\t", 3)
        else:
            text = make(lang, r.randint(1, 80))
        rows.append((i, text, lang, f"s{i % 4}"))
    rows += [(n, None, None, None), (n + 1, "", "en", "s"), (n + 2, " \t\n ", "en", "s"), (n + 3, "12 34 !!", "en", "s"), (n + 4, "a b c", "en", "s"), (n + 5, "A b\x1cc  d", "en", "s"), (n + 6, make("en", 30_000), "en", "s"), (n + 7, "<|endoftext|> x <|im_end|> \\<| 😀", "en", "s"), (n + 8, "x" * 3000, "en", "s")]
    rows.append(rows[1])  # a repeated row
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def shingles(text):
    w = words(text)
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())
