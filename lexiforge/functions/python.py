"""The functions that built-in expressions can't give: small per-row helpers in Arrow-batched UDFs."""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spelled digits.
DIGITS = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine")
#: Phrases that stay as they are.
FIXED_PHRASES = ("ad", "advert", "born", "ball", "recline", "recumb", "repose", "give - and - take", "extravasating")


def _over(kind: str, f, *cols: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*series):
        import pandas as pd

        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series)], dtype=object)

    # the number of arguments must be in the signature that Spark sees
    if len(cols) == 1:
        return F.pandas_udf(lambda a: run.func(a), kind)(*cols)
    return F.pandas_udf(lambda a, b: run.func(a, b), kind)(*cols)


def repetition(tokens: Column) -> Column:
    """struct<n, distinct, same, again> of an array of texts: tokens, distinct ones, those equal to the one before, and bigrams that occur more than once.

    Tokens become numbers in Arrow, and a row's bigrams are counted as numbers; a null array gives null.
    """

    @F.arrow_udf("struct<n:int,distinct:int,same:int,again:int>")
    def run(col: pa.Array) -> pa.Array:
        numbers = col.flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum([0, *[n or 0 for n in pc.list_value_length(col).to_pylist()]])
        out = []
        for a, b in zip(ends, ends[1:]):
            own = numbers[a:b]
            _, n = np.unique(own[:-1] << 32 | own[1:], return_counts=True)
            out.append((len(own), len(np.unique(own)), int((own[1:] == own[:-1]).sum()), int(n[n > 1].sum())))
        names, gone = ("n", "distinct", "same", "again"), pc.is_null(col)
        return pa.StructArray.from_arrays([pa.array([row[k] for row in out], pa.int32()) for k in range(4)], names, mask=gone)

    return run(tokens)


def unmasked(texts: Column, masks: Column, words: Column) -> Column:
    """Texts (an array) with the masks that are listed replaced by their words; ids of masks may have leading zeros."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, masks: pa.Array, words: pa.Array) -> pa.Array:
        mask, out = re.compile(r"(UNK_\w+_)(\d+)", re.ASCII), []
        for own, m, w in zip(texts, masks, words):
            known = dict(zip(m.as_py() or (), w.as_py() or ()))
            put = lambda x: known.get(x[1] + (x[2].lstrip("0") or "0"), x[0])  # noqa: B023, E731
            out.append([t if t is None or not known else mask.sub(put, t) for t in own.as_py()])
        return pa.array(out, pa.list_(pa.string()))

    return run(texts, masks, words)


def statement_parts(c: Column) -> Column:
    """The top-level parenthesised parts of a text, trimmed; what is left over goes with the last.  One pass over its parentheses."""

    def parts(t: str) -> list[str]:
        out, depth, start = [], 0, 0
        for m in re.finditer(r"[()]", t):
            depth += 1 if m.group() == "(" else -1
            if depth == 0 and m.group() == ")":
                out.append(t[start : m.end()].strip(" "))
                start = m.end()
        rest = t[start:].strip(" ")
        if rest:
            out[-1:] = [f"{out[-1]} {rest}" if out else rest]
        return out

    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if t is None else parts(t) for t in col.to_pylist()], pa.list_(pa.string()))

    return run(c)


def subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l_score(reference: str, candidate: str) -> float:
    a, b = reference.split(), candidate.split()
    n = subsequence(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def bleu_score(reference: str, candidate: str, weights: tuple[float, ...] = (0, 1)) -> float:
    """Sentence BLEU of one reference: clipped n-gram precisions, brevity penalty, and the smoothing that gives the k-th
    empty precision 1 / (2^k * 5 / ln(length)) over its n-grams; 0 if no single word is shared."""
    ref, hyp = reference.split(), candidate.split()
    clipped, totals = [], []
    for n in range(1, len(weights) + 1):
        grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: B023,E731
        h, r = grams(hyp), grams(ref)
        clipped.append(sum(min(c, r[g]) for g, c in h.items()))
        totals.append(max(1, sum(h.values())))
    if not clipped[0]:
        return 0.0
    logs, empty = 0.0, 1
    for w, c, t in zip(weights, clipped, totals):
        p = c / t
        if not c and len(hyp) > 1:
            p = 1 / (2**empty * 5 / math.log(len(hyp))) / t
            empty += 1
        if w and p <= 0:
            return 0.0
        logs += w * math.log(p) if w else 0
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(logs)


def nfkc_text(s: str) -> str:
    return re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", s)).strip()


def plain_text(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and c != "�")


def snapped_words(sentence: str, hits: list[int]) -> list[dict]:
    """The words that character positions fall into, once each, without outer punctuation."""
    found = {}
    spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", sentence)]
    for h in sorted(hits):
        for a, b, w in spans:
            if a <= h < b:
                found.setdefault(a, w.strip(string.punctuation))
    return [{"start": a, "word": w} for a, w in sorted(found.items())]


def term_name(word: str, parent: str = "", grandparent: str = "") -> str:
    """A new term's name: the word in camel case, then the parent's name less the grandparent's; leading digits spelled out."""
    if grandparent:
        head, sep, tail = parent.rpartition(grandparent)
        parent = head + tail if sep else parent
    own = re.sub(r"[-_](\w)", lambda m: m[1].upper(), word)
    name = re.sub(r"[^a-zA-Z0-9]", "", own) + parent
    name = name[:1].upper() + name[1:]
    digits = len(name) - len(name.lstrip("0123456789"))
    return "".join(DIGITS[int(d)] for d in name[:digits]) + name[digits:]


def gerund_of(phrase: str, known: frozenset[str] = frozenset()) -> str:
    """The -ing form of a one-word verb if it is a known word (any, without a list), else the phrase."""
    if phrase in FIXED_PHRASES:
        return phrase
    words = (phrase.strip()[3:] if phrase.strip().lower().startswith("to ") else phrase.strip()).split()
    if not words or words[0].lower().endswith("ing"):
        return " ".join(words)
    w = words[0]
    if w.endswith("e") and not w.endswith(("ee", "oe", "ye")):
        stem = w[:-1]
    elif len(w) > 4 and w.endswith("tion"):
        stem = w[:-3]
    elif len(w) > 2 and w[-1] not in "aeiouwxy" and w[-2] in "aeiou" and w[-3] not in "aeiou":
        stem = w + w[-1]
    else:
        stem = w
    form = stem + "ing"
    return " ".join([form, *words[1:]]) if not known or form.lower() in known else " ".join(words)


def scrambled_text(s: str, codes: dict[str, str]) -> str:
    """Words and question marks outside quotes replaced by their codes; unknown ones stay."""
    parts = re.split(r'(".*?")', s)
    return "".join(p if i % 2 else re.sub(r"\b\w+\b|\?", lambda m: codes.get(m[0], m[0]), p) for i, p in enumerate(parts))


def unscrambled_text(s: str, words: dict[str, str]) -> str:
    """Runs of five capitals outside quotes replaced by their words, adjacent codes included, the last one too."""
    parts = re.split(r'(".*?")', s, flags=re.S)
    return "".join(p if i % 2 else re.sub(r"[A-Z]{5}", lambda m: words.get(m[0], m[0]), p) for i, p in enumerate(parts))


def tree_depth(heads: list[int]) -> int:
    """Nodes on the longest way from the root (its own head) to a leaf; -1 for a cycle."""
    depth = {i: 1 for i, h in enumerate(heads) if h == i}
    for i in range(len(heads)):
        path = []
        while i not in depth:
            if i in path or not 0 <= i < len(heads):
                return -1
            path.append(i)
            i = heads[i]
        for d, j in enumerate(reversed(path), depth[i] + 1):
            depth[j] = d
    return max(depth.values(), default=0)


def clauses_of(tokens: list[dict]) -> list[str]:
    """The main clause and those joined by and / but, as texts; tokens have i, head, text and dep."""
    below: dict[int, list[int]] = {}
    for t in tokens:
        if t["head"] != t["i"]:
            below.setdefault(t["head"], []).append(t["i"])
    text = {t["i"]: t["text"] for t in tokens}

    def span(root: int) -> str:
        seen, todo = set(), [root]
        while todo:
            if (i := todo.pop()) not in seen:
                seen.add(i)
                todo += below.get(i, [])
        return " ".join(text[i] for i in sorted(seen))

    roots = [t["i"] for t in tokens if t["dep"] == "ROOT"]
    if not roots:
        return []
    return [span(roots[0])] + [span(t["head"]) for t in tokens if t["text"].lower() in ("and", "but") and t["dep"] == "cc"]


def assembled(words: list[dict]) -> str:
    """A sentence of its words: pronouns with a representative replaced (possessives get 's), punctuation and hyphens attached."""
    out = ""
    for w in words:
        t = w["text"]
        if w.get("rep") and w.get("upos") == "PRON":
            out += w["rep"] + ("'s " if w.get("poss") else " ")
        elif t in (".", ",", "!", "?", "'s", ":", ";"):
            out = out[:-1] + t + " "
        elif t in ("-", "–"):
            out = out[:-1] + t
        else:
            out += t + " "
    return out.strip()


def rouge_l(reference: Column, candidate: Column) -> Column:
    return _over("double", rouge_l_score, reference, candidate)


def bleu2(reference: Column, candidate: Column) -> Column:
    return _over("double", bleu_score, reference, candidate)


def nfkc(c: Column) -> Column:
    return _over("string", nfkc_text, c)


def without_marks(c: Column) -> Column:
    return _over("string", plain_text, c)


def snapped(sentence: Column, hits: Column) -> Column:
    return _over("array<struct<start:int,word:string>>", lambda s, h: snapped_words(s, list(h)), sentence, hits)


def starts(lengths: Column) -> Column:
    """Where each word of a text begins (array<long>), from their lengths with one character between them."""
    return _over("array<long>", lambda n: (np.cumsum(np.asarray(n, dtype=np.int64) + 1) - n - 1).tolist(), lengths)


def gerund(c: Column) -> Column:
    return _over("string", gerund_of, c)


def scrambled(c: Column, codes: dict[str, str]) -> Column:
    return _over("string", lambda s: scrambled_text(s, codes), c)


def unscrambled(c: Column, codes: dict[str, str]) -> Column:
    back = {v: k for k, v in codes.items()}
    return _over("string", lambda s: unscrambled_text(s, back), c)


def depth(heads: Column) -> Column:
    return _over("int", lambda h: tree_depth(list(h)), heads)


#: Similarities by name; an unknown name raises.
SIMILARITIES = {"rouge": rouge_l, "bleu": bleu2}


def similarity(name: str, reference: Column, candidate: Column) -> Column:
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}: one of {', '.join(SIMILARITIES)}")
    return SIMILARITIES[name](reference, candidate)
