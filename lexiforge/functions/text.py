"""Text functions on columns, composed of built-in expressions so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.python import statement_parts  # noqa: F401  (the one function here that built-in expressions can't give in one pass)

# Fixed values of the logic language and its tools.
TERM = r"(?<!\?)\b[a-zA-Z_][a-zA-Z_0-9]*\b"
VARIABLE = r"\?\w+"
PROMPT_KEYWORDS = ("now", "instance", "subclass", "exists", "forall", "relation", "subrelation", "attribute", "and", "or", "xor", "not", "=>")
CHECK_KEYWORDS = ("subclass", "relation", "subrelation", "instance", "and", "or", "xor", "exists", "forall", "=>", "not", "Now", "equal")
IGNORED = ("exists", "and", "or", "not", "instance", "now")
ENTITY_TERMS = {
    "EVENT": "SocialInteraction",
    "FAC": "Facility",
    "GPE": "GeopoliticalArea",
    "LANGUAGE": "NaturalLanguage",
    "LAW": "DeonticAttribute",
    "LOC": "GeographicArea",
    "MONEY": "CurrencyMeasure",
    "NORP": "GroupOfPeople",
    "ORG": "Organization",
    "PERSON": "Human",
    "PRODUCT": "Product",
    "WORK_OF_ART": "ArtWork",
}


def ascii_only(c: Column) -> Column:
    """Everything outside ASCII becomes a space."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def words(c: Column) -> Column:
    """Whitespace-separated words; a blank text has none."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


# ---- terms ----


def logic_terms(c: Column) -> Column:
    """Identifiers outside variables, repeats kept; operators and quoted words count too."""
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(0))


def named_terms(c: Column) -> Column:
    """logic_terms without masks of unknown words."""
    return F.filter(logic_terms(c), lambda t: ~t.startswith("UNK"))


def known_terms(c: Column, known: Column) -> Column:
    """The distinct logic terms that an array of known terms has."""
    return F.array_intersect(F.array_distinct(logic_terms(c)), known)


def known_in(rows: DataFrame, key: str, c: str, known: DataFrame) -> DataFrame:
    """(key, term), once each: the logic terms of a text that a table of known terms (term) has; both sides are shuffled by term."""
    own = rows.select(key, F.explode(F.array_distinct(logic_terms(F.col(c)))).alias("term")).distinct()
    return own.join(known.select("term").distinct(), "term", "left_semi").select(key, "term")


def prompt_terms(c: Column, keywords: tuple[str, ...] = PROMPT_KEYWORDS) -> Column:
    """Tokens outside quotes and parentheses, without variables and keywords (any case)."""
    bare = F.regexp_replace(c, r'"[^"]*"', "")
    return F.filter(F.split(bare, r"[\s()]+"), lambda t: (t != "") & ~t.startswith("?") & ~F.lower(t).isin(*[k.lower() for k in keywords]))


def without_quotes(c: Column) -> Column:
    """A blank for each quoted text (escapes respected); from a quote that never closes on, the text stays (and a blank follows).

    The repeats are possessive: the regex engine then loops where it would else recurse once for each character.
    """
    return F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"|("(?:[^"\\]|\\.)*+\z)', "$1 ")


def checked_terms(c: Column, keywords: tuple[str, ...] = CHECK_KEYWORDS) -> Column:
    """Tokens outside quotes (escapes respected), without variables, keywords, pure numbers and unknown marks; quotes of any length."""
    bare = F.translate(without_quotes(c), "()", "  ")
    keep = lambda t: (t != "") & ~t.startswith("?") & ~t.isin(*keywords) & ~t.rlike(r"^\d+$") & ~t.startswith("UNK_")
    return F.filter(F.split(F.trim(bare), r"\s+"), keep)


def statement_words(c: Column) -> Column:
    """Words of a statement without quoted text, punctuation, variables and the ignored words."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(c, r'"[^"]*"', ""), "()", "  "), r"(?U)[^\w\s?]", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?U)\??\b\w+\b"), F.lit(0))
    return F.filter(found, lambda w: ~w.startswith("?") & ~F.lower(w).isin(*IGNORED))


def term_format_head(c: Column) -> Column:
    """The term of a termFormat line, else an empty text."""
    return F.regexp_extract(c, r'^\(termFormat EnglishLanguage (\S+) ".*"\)', 1)


# ---- variables and spacing ----


def joined_variables(c: Column) -> Column:
    """A question mark and the spaces after it become the mark alone."""
    return F.regexp_replace(c, r"\? +", "?")


def numbered_variables(c: Column, compat: bool = False) -> Column:
    """Variables renamed ?X1, ?X2, ... in order of first appearance.

    compat replaces them as substrings one after another, so a name that begins another damages it.
    """
    found = F.regexp_extract_all(c, F.lit(VARIABLE), F.lit(0))
    names = F.array_distinct(found)
    if compat:
        numbered = F.transform(names, lambda v, i: F.struct(v.alias("v"), (i + 1).cast("string").alias("n")))
        return F.aggregate(numbered, c, lambda acc, x: F.replace(acc, x["v"], F.concat(F.lit("?X"), x["n"])))
    # a lambda binds the distinct names once for all of the text
    new = F.get(F.transform(F.array(names), lambda ns: F.transform(found, lambda v: F.concat(F.lit("?X"), F.array_position(ns, v).cast("string")))), F.lit(0))
    pieces = F.arrays_zip(F.split(c, VARIABLE, -1).alias("p"), new.alias("n"))
    return F.array_join(F.flatten(F.transform(pieces, lambda x: F.array(x["p"], F.coalesce(x["n"], F.lit(""))))), "")


def spaced_english(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ",", " , "), " +", " ")


def spaced_logic(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([()?])", r" $1 "), " +", " ")


def spaced_marks(c: Column) -> Column:
    """'? ' becomes ' ?', then each '?' gets a space before it (so double spaces arise)."""
    return F.replace(F.replace(c, F.lit("? "), F.lit(" ?")), F.lit("?"), F.lit(" ?"))


def attached_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r" ([,.])", "$1")


def unnumbered(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\d+\.\s*", "")


def unquoted(c: Column) -> Column:
    """The text between one quote at either end, trimmed; null if it isn't quoted."""
    return F.when(c.startswith('"') & c.endswith('"') & (F.length(c) >= 2), F.trim(F.substr(c, F.lit(2), F.length(c) - 2)))


def without_returns(c: Column) -> Column:
    return F.replace(c, F.lit("\r"), F.lit(""))


def format_word(c: Column) -> Column:
    """A word as a logic identifier."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^a-zA-Z0-9,.!?\s]", "_"), "[,.!?]", "")
    return F.replace(F.when(plain.rlike("^[0-9]"), F.concat(F.lit("num_"), plain)).otherwise(plain), F.lit(" "), F.lit("_"))


def entity_term(c: Column) -> Column:
    """The logic term for an entity type, null for dates and unknown types."""
    out = F.lit(None).cast("string")
    for kind, term in ENTITY_TERMS.items():
        out = F.when(c == kind, term).otherwise(out)
    return out


def word_type(c: Column, phrases: bool = False) -> Column:
    """noun and verb by part of speech; the older tool knows noun-phrase for proper nouns too."""
    out = F.when(c == "NOUN", "noun").when(c == "VERB", "verb")
    return out.when(c == "PROPN", "noun-phrase") if phrases else out


def wordnet_pos(c: Column) -> Column:
    return F.when(c.startswith("J"), "a").when(c.startswith("V"), "v").when(c.startswith("N"), "n").when(c.startswith("R"), "r")


# ---- prompts and replies ----


def translation_prompt(c: Column) -> Column:
    return F.concat(F.lit("Convert the following sentence to SUO-KIF: "), F.trim(c))


def candidate_prompt(sentence: Column, terms: Column) -> Column:
    return F.format_string('Convert to SUO-KIF. Sentence: "%s" Only use terms from this list: [%s].', sentence, F.array_join(terms, ", "))


def verdict(c: Column) -> Column:
    """-1 for Invalid, 1 for Valid, null for neither (case counts)."""
    return F.when(F.contains(c, F.lit("Invalid")), -1).when(F.contains(c, F.lit("Valid")), 1)


def yes(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("yes"))


def resolved_output(c: Column, marker: str = "The resolved output is:") -> Column:
    return F.trim(F.substring_index(c, marker, -1))


def reply_field(c: Column, field: str = "classification") -> Column:
    return F.get_json_object(c, f"$.{field}")


def last_object(c: Column) -> Column:
    """From the last opening brace to the next closing one, as map<string,string>; null if that isn't JSON."""
    inner = F.substring_index(F.substring_index(c, "{", -1), "}", 1)
    parsed = F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), "map<string,string>")
    return F.when(F.contains(c, F.lit("{")) & (F.map_contains_key(parsed, "Simple") | F.map_contains_key(parsed, "recommendation")), parsed)


def numbered_replies(c: Column) -> Column:
    """The entries with digit keys of the outermost object; missing and trailing commas are mended."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    mended = F.regexp_replace(F.regexp_replace(body, r'"\s*\n\s*"', '",\n"'), r",\s*\}", "}")
    return F.map_filter(F.from_json(mended, "map<string,string>"), lambda k, _: k.rlike(r"^\d+$"))


def balanced(c: Column) -> Column:
    """As many opening as closing parentheses."""
    return F.regexp_count(c, F.lit(r"\(")) == F.regexp_count(c, F.lit(r"\)"))


def sentences(c: Column) -> Column:
    """Sentences of a text, split after ., ! and ? before white space, without spaces (of any kind) at their ends."""
    # F.trim itself would take the place that transform hands it for the characters to trim
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\p{Zs}+|\p{Zs}+\z", "")), lambda s: s != "")


# ---- shape ----


def _ratio(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def shape(c: Column) -> dict[str, Column]:
    """Punctuation, digit and upper-case shares, and the imbalance of parentheses and brackets."""
    n = F.length(c)
    gap = lambda a, b: F.abs(F.regexp_count(c, F.lit(a)) - F.regexp_count(c, F.lit(b)))
    return {
        "punct_ratio": _ratio(F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]")), n),
        "digit_ratio": _ratio(F.regexp_count(c, F.lit(r"\p{Nd}")), n),
        "upper_ratio": _ratio(F.regexp_count(c, F.lit(r"\p{Lu}")), n),
        "paren_imbalance_abs": gap(r"\(", r"\)").cast("double"),
        "bracket_imbalance_abs": (gap(r"\[", r"\]") + gap(r"\{", r"\}")).cast("double"),
    }


def lexical(c: Column) -> dict[str, Column]:
    """Words, the share of distinct words, and words by characters (0 for blank texts)."""
    w = words(c)
    chars = F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, x: a + x)
    return {"sentence_length": F.size(w), "lexical_diversity": _ratio(F.size(F.array_distinct(w)), F.size(w)), "readability": _ratio(F.size(w), chars)}


def complexity_bin(terms: Column) -> Column:
    """Bins of five terms: 0-4 is 0, ..., 35 and more is 7."""
    return F.least(F.floor(F.size(terms) / 5), F.lit(7)).cast("int")
