"""Company names against the brand part of a host name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.text import ascii_folded

# Words of company names that addresses leave out.
COMPANY_WORDS = [
    "the", "inc", "incorporated", "ltd", "limited", "llc", "plc", "gmbh", "ag", "sa", "co", "corp", "corporation",
    "company", "group", "holdings",
]
ENOUGH = 0.7


def name_words(name: Column) -> Column:
    """Words of a name in lower-case ASCII, without company words; none if it has nothing else."""
    plain = F.lower(ascii_folded(F.translate(name, "’‘`", "'''")))
    words = F.regexp_extract_all(F.translate(plain, "'.", ""), F.lit("([a-z0-9]+|&)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(COMPANY_WORDS))


def match_words(words: Column, label: Column) -> Column:
    """1.0 equal, 0.8 one holds the other, 0.7 every word is in the label, 0.4 the first is, else 0."""
    label = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    plain = F.array_join(F.filter(words, lambda w: w != "&"), "")
    spelled = F.array_join(F.transform(words, lambda w: F.when(w == "&", F.lit("and")).otherwise(w)), "")
    holds = lambda key: (F.length(key) >= 4) & (F.length(label) >= 4) & (F.contains(label, key) | F.contains(key, label))
    tokens = F.filter(words, lambda w: ~w.isin("&", "and") & (F.length(w) >= 2))
    first = F.get(tokens, F.lit(0))
    return (
        F.when((label == "") | (F.size(words) == 0), F.lit(0.0))
        .when((plain == label) | (spelled == label), F.lit(1.0))
        .when(holds(plain) | holds(spelled), F.lit(0.8))
        .when((F.size(tokens) >= 2) & F.forall(tokens, lambda t: F.contains(label, t)), F.lit(0.7))
        .when(F.coalesce((F.length(first) >= 3) & F.contains(label, first), F.lit(False)), F.lit(0.4))
        .otherwise(F.lit(0.0))
    )


def name_match(name: Column, label: Column) -> Column:
    return match_words(name_words(name), label)
