"""Small documents with every awkward case, and brute-force helpers."""

import random
import re

EXTRA = ["k", "t", "h", "cls", "kept", "n_words", "n_lines", "_rest", "length", "piece"]


def texts(seed: int = 5) -> list:
    rng = random.Random(seed)
    vocab = ["a", "of", "the", "Éa", "ño", "x1", "foo", "BAR", "baz.", "qux,", "漢字", "l'eau", "w%%%"] + [
        f"w{i}" for i in range(40)]
    passage = [f"p{i}" for i in range(55)]
    out: list = [None, "", " \n\t ", "a", "one\n\n\ntwo  three", "tab\there\x0bvt", "a b c", "a b c", "\x00nul \x01"]
    for i in range(30):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.randint(5, 55)]
        out.append(" ".join(w) + ("\nCommon line\n" if i % 2 else ""))
    out += [out[12], out[12], out[13] + " tail", out[14].replace("w1", "w2", 1)]
    out.append(" ".join(rng.choice(vocab) for _ in range(30_000)))  # very long
    return out


def rows(seed: int = 5) -> list[tuple]:
    """(doc_id, text): unique ids but for a NULL id and one row given twice."""
    ts = texts(seed)
    out = [(i * 3 % 101 + 101 * (i // 101), t) for i, t in enumerate(ts)]
    out.append((None, "no identifier " + "z " * 25))
    out.append(out[20])
    return out


def frame(spark, data, extra: bool = True):
    """A DataFrame of the rows, with further columns whose names clash with inner ones."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(data, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in EXTRA}) if extra else df


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=False) -> list[str]:
    if text is None:
        return []
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, text)
