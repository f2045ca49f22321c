"""Rule-based understanding of short questions. Dictionaries are parameters: plain Python maps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.functions.scalars import first_of
from quern.functions.text import keyword_tokens, normalise_query, partial_similarity, squeezed_form, utterance


#: A longer lexicon is matched by an automaton in one pass instead of a test a term.
FEW_TERMS = 64


def lexicon_hits(c: Column, terms: list[str]) -> Column:
    """Terms that stand in the text, by end of first match, longer ones first."""
    if len(terms) > FEW_TERMS:
        return _automaton(terms)(c)

    def place(t):
        return F.struct((F.locate(t, c) + len(t)).alias("end"), F.lit(-len(t)).alias("len"), F.lit(t).alias("term"))

    found = F.filter(F.array(*[F.when(F.contains(c, F.lit(t)), place(t)) for t in terms]), lambda x: x.isNotNull())
    return F.transform(F.array_sort(found), lambda x: x["term"])


def _automaton(terms: list[str]):
    @F.pandas_udf(ArrayType(StringType()))
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in terms:
            a.add_word(t, t)
        a.make_automaton()

        def one(s):
            if s is None:
                return []
            first: dict[str, int] = {}
            for end, t in a.iter(s):
                first.setdefault(t, end)
            return sorted(first, key=lambda t: (first[t], -len(t), t))

        for b in batches:
            yield pd.Series([one(s) for s in b], dtype="object")

    return f


def expand_synonyms(c: Column, synonyms: Mapping[str, list[str]]) -> Column:
    """Synonyms of terms in the text that do not stand in it are appended."""
    more = F.array_distinct(F.flatten(F.array(*[F.when(F.contains(c, F.lit(t)), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for t, s in synonyms.items()])))
    more = F.filter(more, lambda s: ~F.contains(c, s))
    return F.when(F.size(more) > 0, F.concat(c, F.lit(" "), F.array_join(more, " "))).otherwise(c)


def keywords(c: Column, terms: list[str], stopwords: list[str], most: int = 12) -> Column:
    tokens = F.filter(keyword_tokens(c), lambda t: ~t.isin(*stopwords))
    return F.slice(F.array_distinct(F.concat(lexicon_hits(c, terms), tokens)), 1, most)


def entities(c: Column, words: Column, groups: Mapping[str, Mapping[str, list[str]]], labels: Mapping[str, list[tuple[str, str]]] | None = None) -> Column:
    """map<group, array<name>>: a name is found by itself among the keywords or by one of its words in the text.
    ``labels``: per group, patterns whose label joins the group's names when they match, in order."""
    entries = []
    for group, names in groups.items():
        hit = [F.when(F.array_contains(words, n) | F.coalesce(c.rlike("|".join(_quote(w) for w in [n, *ws])), F.lit(False)), F.lit(n)) for n, ws in names.items()]
        hit += [F.when(F.coalesce(c.rlike(p), F.lit(False)), F.lit(label)) for p, label in (labels or {}).get(group, [])]
        entries.append(F.struct(F.lit(group), F.array_distinct(F.filter(F.array(*hit), lambda x: x.isNotNull()))))
    return F.map_from_entries(F.array(*entries))


def _quote(w: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|-/" else ch for ch in w)


def filters(found: Column, hints: Mapping[str, list[str]], known: list[str] | None = None) -> Column:
    """Groups with values, each value once; with ``known`` only those keys, in that order.  The first category brings
    the document categories it hints at."""
    kept = F.map_filter(F.transform_values(found, lambda _, v: F.array_distinct(v)), lambda _, v: F.size(v) > 0)
    if known:
        one = lambda k: F.when(F.map_contains_key(kept, k), F.struct(F.lit(k).alias("key"), F.element_at(kept, k).alias("value")))
        kept = F.map_from_entries(F.filter(F.array(*map(one, known)), lambda e: e.isNotNull()))
    first = first_of(F.element_at(found, "category"))
    hint = F.lit(None).cast("array<string>")
    for k, v in hints.items():
        hint = F.when(first == k, F.array(*map(F.lit, v))).otherwise(hint)
    return F.when(hint.isNotNull(), F.map_concat(kept, F.create_map(F.lit("document_category"), hint))).otherwise(kept)


def variants(query: Column, compact: Column, expansions: Column) -> Column:
    """The query, with compact terms, with expansions, with both; distinct, in this order."""
    a, b = F.array_join(compact, " "), F.array_join(expansions, " ")
    return F.filter(F.array_distinct(F.array(F.btrim(query), F.btrim(F.concat_ws(" ", query, F.nullif(a, F.lit("")))), F.btrim(F.concat_ws(" ", query, F.nullif(b, F.lit("")))),
                                             F.btrim(F.concat_ws(" ", query, F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))))), lambda q: q != "")


def understand(df: DataFrame, question: str, *, replacements=(), synonyms: Mapping[str, list[str]], terms: list[str], stopwords: list[str],
               groups: Mapping[str, Mapping[str, list[str]]], expansions: Mapping[str, list[str]], hints: Mapping[str, list[str]],
               entity_expansions: Mapping[str, list[str]] | None = None, labels: Mapping[str, list[tuple[str, str]]] | None = None, known: list[str] | None = None) -> DataFrame:
    """Adds the columns of the whole chain: normalized_query, keywords, entities, filters, category, rewritten_queries.
    ``expansions`` go by a part of the query, ``entity_expansions`` by the name of an entity found."""
    none = F.array().cast("array<string>")
    q, words, found = F.col("normalized_query"), F.col("keywords"), F.col("entities")
    names = F.array_sort(F.array_distinct(F.flatten(F.map_values(found))))
    more = F.array_distinct(F.flatten(F.array(none, *[F.when(F.contains(q, F.lit(t)), F.array(*map(F.lit, e))).otherwise(none) for t, e in expansions.items()])))
    if entity_expansions:
        by_name = F.flatten(F.array(none, *[F.when(F.array_contains(names, n), F.array(*map(F.lit, e))).otherwise(none) for n, e in entity_expansions.items()]))
        more = F.array_distinct(F.concat(more, by_name))
    return (df.withColumn("normalized_query", normalise_query(F.col(question), list(replacements)))
            .withColumn("normalized_query", expand_synonyms(q, synonyms))
            .withColumn("keywords", keywords(q, terms, stopwords)).withColumn("entities", entities(q, words, groups, labels))
            .withColumns({"filters": filters(found, hints, known), "category": first_of(F.element_at(found, "category")), "rewritten_queries": variants(q, names, more)}))


def intent(c: Column, *, abuse: Column, domain: list[str], question: list[str], time: list[str], patterns: list[str]) -> Column:
    """PROFANITY, then GENERAL for nothing said, INFO for a domain word or a question word with a time word or
    pattern, else GENERAL."""
    u = utterance(c)
    has = lambda ws: u.rlike("|".join(_quote(w) for w in ws))
    timed = has(time) | u.rlike("|".join(patterns))
    return F.when(abuse, "PROFANITY").when(u == "", "GENERAL").when(has(domain) | (has(question) & timed), "INFO").otherwise("GENERAL")


def abusive(c: Column, words: list[str], patterns: list[str], soft: list[str] = (), contexts: list[str] = ()) -> Column:
    """Word list on the squeezed form, patterns on the raw, the spaced and the squeezed form, soft words only within
    their contexts."""
    squeezed, spaced, raw = squeezed_form(c), squeezed_form(c, keep_blanks=True), F.lower(F.coalesce(c, F.lit("")))
    out = squeezed.rlike("|".join(_quote(w) for w in words)) if words else F.lit(False)
    if patterns:
        p = "|".join(f"(?:{x})" for x in patterns)
        out = out | raw.rlike(p) | spaced.rlike(p) | squeezed.rlike(p)
    if soft:
        out = out | (squeezed.rlike("|".join(_quote(w) for w in soft)) & raw.rlike("|".join(f"(?:{x})" for x in contexts)))
    return F.coalesce(out, F.lit(False))


def general_intent(c: Column, exact: Mapping[str, list[str]], roots: Mapping[str, list[str]], default: str = "unknown") -> Column:
    """Exact utterances first, then the first kind with a root inside the utterance."""
    u = utterance(c)
    out = F.lit(default)
    for kind, ws in reversed(list(roots.items())):
        out = F.when(u.rlike("|".join(_quote(w) for w in ws)), kind).otherwise(out)
    for kind, ws in reversed(list(exact.items())):
        out = F.when(u.isin(*ws), kind).otherwise(out)
    return out


def nearest_intent(examples: list[tuple[str, str]], threshold: float = 65.0):
    """Column function: intent of the most similar example (first of equals), null below ``threshold``."""
    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            best, kind = -1.0, None
            for k, e in examples:
                v = partial_similarity(x, e)
                if v > best:
                    best, kind = v, k
            return kind if best >= threshold else None
        return s.map(one)
    return f
