"""Small tables with every awkward case, and plain Python versions of what the operators promise."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_texts():
    """Null, empty, blank, short, very long, odd white space, repeats inside a text, near and exact copies."""
    rng = random.Random(7)
    base, passage = prose(rng, 300), prose(rng, 60)
    cut = base.split(" ")
    texts = [None, "", "   \n\t ", "one", "one two", "one two three", "Ünï cödé wörds 🙂   end", "a\x0bb\x0cc\x1fd\x85e"]
    texts += [base, base, base + " ", base.replace(" ", "\n", 3), base.upper()]
    texts += [" ".join([*cut[:k], f"edit{k}", *cut[k + 1 :]]) for k in (5, 50, 150, 250)]
    texts += [f"{prose(rng, 90)} {passage} {prose(rng, 30)}", f"{passage} {prose(rng, 50)}", f"{passage} {passage}"]
    texts += ["the " * 200, prose(rng, 20_000, 5_000), "x" * 50_000, "line\nline\nother\nline", "#### $$$$ %%%% && ||" * 5]
    texts += [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    return texts


def awkward_rows():
    """Ids with a null and repeats; rows that repeat whole."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t) if t is not None else None) for i, t in enumerate(awkward_texts())]
    rows += [rows[8], rows[9], rows[0], (None, "a null id with a text of its own", "en", None, 3), (None, rows[8][1], None, None, 0)]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
