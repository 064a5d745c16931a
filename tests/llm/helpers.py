"""Plain-Python versions that the operators are compared with."""

import re
import string

AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return [w.translate(AZ) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, width=5):
    w = words_of(text)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, component_id string, h string, i string, x string, rate string"


def edge_cases(spark, *texts):
    """Documents with nulls, empty, blank and very long texts, repeats, and columns whose names clash."""
    rows = [None, "", " \n\t", "word", "a b c d e", "a b c d e", "A B  C d e", "x" * 5000, "long text of words " * 4000, "é ü 日本   end", *texts]
    full = [(k, t, None, "s", None, "n", "s", "c", "h", "i", "x", "r") for k, t in enumerate(rows)]
    full += [full[4], (None, "null id text here now", None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(full, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
