"""Prompt builders for language models, as columns: our own wording for each of the steps that ask one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rewrite_batch(sentence: Column, flagged: Column, n: int = 10, again: bool = False) -> Column:
    """Ask for n literal rewrites as a JSON object with number keys; flagged is an array of words taken for metaphors."""
    head = "Earlier answers kept figurative words. " if again else ""
    return F.format_string(
        head + 'Write %d literal versions of the sentence, keeping its meaning. Figurative words: %s. Sentence: "%s" Answer with a JSON object whose keys are "1" to "%d".',
        F.lit(n), F.array_join(flagged, ", "), sentence, F.lit(n),
    )


def retry(sentence: Column, too_figurative: Column, too_different: Column, both: Column) -> Column:
    """Ask again, listing what failed and how, in three sections; empty sections are left out."""
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, " | "), F.lit(". "))).otherwise("")
    return F.concat(
        F.lit("Try again with a literal version. "), part("Still figurative: ", too_figurative), part("Changed the meaning: ", too_different), part("Both: ", both),
        F.lit('Sentence: "'), sentence, F.lit('"'),
    )


def simplify(sentence: Column, originals: list[str], simple: list[str]) -> Column:
    """Ask for a simpler sentence, with examples; the two lists must be of equal length."""
    if len(originals) != len(simple):
        raise ValueError("as many originals as simple sentences are needed")
    shots = " ".join(f'Original: "{a}" Simple: "{b}".' for a, b in zip(originals, simple))
    return F.concat(F.lit(f'Split or shorten the sentence without adding facts. {shots} Original: "'), sentence, F.lit('" Answer as JSON with the key "Simple".'))


def mend_json(reply: Column) -> Column:
    return F.concat(F.lit("Give the same answer as one valid JSON object: "), reply)


def added_facts(original: Column, simple: Column) -> Column:
    return F.format_string('Does the second text state anything that the first does not? Answer Yes or No. First: "%s" Second: "%s"', original, simple)


def pronouns(sentence: Column) -> Column:
    return F.format_string('Can a pronoun in the text be replaced by a noun from it? Answer Yes or No. Text: "%s"', sentence)


def word_sense(sentence: Column, word: Column, senses: Column) -> Column:
    return F.format_string('Which sense does "%s" have in "%s"? %s. Answer with its number.', word, sentence, F.array_join(F.transform(senses, lambda s, i: F.concat((i + 1).cast("string"), F.lit(") "), s)), "; "))
