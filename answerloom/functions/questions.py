"""Parts of a question text, each as its own column expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions.text import UNICODE, all_matches, contains_any, first_match, let, strip


def question_id(text: Column) -> Column:
    number = first_match(text, UNICODE + V.QUESTION_ID)
    return F.concat(F.lit("Q"), number)


def extract_urls(text: Column) -> Column:
    """Absolute URLs in text order, without closing punctuation."""
    found = all_matches(text, UNICODE + V.ABSOLUTE_URL)
    return F.transform(found, lambda url: F.regexp_replace(url, V.URL_TRAILING, ""))


def relative_urls(text: Column) -> Column:
    """Relative references by pattern order, each once."""
    return F.array_distinct(F.concat(*[all_matches(text, UNICODE + p, 1) for p in V.RELATIVE_URLS]))


def _is_data_url(url: Column) -> Column:
    low = F.lower(url)
    return contains_any(low, V.DATA_URL_EXTENSIONS) | ~contains_any(low, V.SUBMIT_URL_MARKS)


def data_sources(urls: Column) -> Column:
    return F.filter(urls, _is_data_url)


def submit_url(urls: Column) -> Column:
    """The last URL that is a submission address, null when there is none."""
    return F.try_element_at(F.filter(urls, lambda u: ~_is_data_url(u)), F.lit(-1))


def relative_submit_url(text: Column, absolute: Column) -> Column:
    """First relative submission address, only where no absolute one was found."""
    found = F.coalesce(*[first_match(text, "(?iU)" + p) for p in V.RELATIVE_SUBMIT_URLS])
    return F.when(absolute.isNull(), found)


def instruction_snippets(text: Column) -> Column:
    """Up to two snippets per keyword: the keyword and the characters after it."""
    snippets = [
        F.slice(all_matches(text, "(?iU)" + word + V.INSTRUCTION_TAIL), 1, V.INSTRUCTIONS_PER_KEYWORD)
        for word in V.INSTRUCTION_KEYWORDS
    ]
    return F.concat(*snippets)


def answer_format(text: Column) -> Column:
    return let(
        F.lower(text),
        lambda low: F.when(contains_any(low, V.NUMBER_PHRASES), "number")
        .when(contains_any(low, V.IMAGE_WORDS), "base64_image")
        .when(low.contains("json") & low.contains("answer"), "json")
        .otherwise("string"),
    )


def description(text: Column) -> Column:
    sentence = F.get(F.split(text, V.SENTENCE_END, 2), F.lit(0))
    return F.substring(strip(sentence), 1, V.DESCRIPTION_LENGTH)


def hint_tags(text: Column, hints: Mapping[str, Sequence[str]]) -> Column:
    """Names of the hint families with a word in the text, in family order."""

    def tags(low: Column) -> Column:
        found = [F.when(contains_any(low, [w.lower() for w in ws]), F.lit(name)) for name, ws in hints.items()]
        return F.array_compact(F.array(*found))

    return let(F.lower(text), tags)


def strip_code_fence(text: Column) -> Column:
    """Text between a leading fence line and its closing fence."""
    clean = strip(text)
    lines = F.split(clean, "\n")
    last_is_fence = strip(F.try_element_at(lines, F.lit(-1))) == V.CODE_FENCE
    inner = F.slice(lines, F.lit(2), F.size(lines) - F.when(last_is_fence, 2).otherwise(1))
    body = F.when(F.size(lines) > 2, F.array_join(inner, "\n")).otherwise(clean)
    return F.when(clean.startswith(V.CODE_FENCE), strip(body)).otherwise(clean)


def strip_answer_prefix(text: Column) -> Column:
    out = text
    for prefix in V.ANSWER_PREFIXES:
        starts = F.lower(out).startswith(prefix.lower())
        out = F.when(starts, strip(F.substring(out, len(prefix) + 1, 2147483647))).otherwise(out)
    return out


def build_context(parts: Mapping[str, Column]) -> Column:
    """Labelled sections of the texts given, empty ones left out."""
    sections = []
    for label, name, limit in V.CONTEXT_SECTIONS:
        if name in parts:
            text = parts[name]
            cut = text if limit is None else F.substring(text, 1, limit)
            sections.append(F.when(F.length(text) > 0, F.concat(F.lit(label), cut)))
    joined = F.concat_ws("\n\n", *sections)
    return F.when(joined == "", F.lit(V.EMPTY_CONTEXT)).otherwise(joined)


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens: one for every four characters begun."""
    return F.ceil(F.length(text) / V.CHARACTERS_PER_TOKEN)


def cutoff(text: Column) -> Column:
    """The cutoff a question names. Texts without the word are not searched further."""
    found = F.coalesce(
        first_match(text, "(?iU)" + V.CUTOFF),
        first_match(text, UNICODE + V.CUTOFF_VALUE),
    )
    return F.when(F.lower(text).contains(V.CUTOFF_WORD), found.try_cast("bigint"))


def cutoff_inclusive(text: Column) -> Column:
    """True where the question asks for at least the cutoff, else above it."""
    return F.lower(text).contains(V.AT_LEAST_PHRASE) | text.contains(V.AT_LEAST_SIGN)


def metric(text: Column) -> Column:
    """The metric a question asks for, by whole words in a fixed order."""
    words = (V.SUM_WORDS, V.TOTAL_WORDS, V.COUNT_WORDS, V.MEAN_WORDS, V.MAX_WORDS, V.MIN_WORDS)
    every = "|".join(dict.fromkeys(word for family in words for word in family))

    def choose(found: Column) -> Column:
        def any_of(family: Sequence[str]) -> Column:
            return F.arrays_overlap(found, F.array(*map(F.lit, family)))

        return (
            F.when(any_of(V.SUM_WORDS) & cutoff(text).isNotNull(), "cutoff_sum")
            .when(any_of(V.TOTAL_WORDS), "sum")
            .when(any_of(V.COUNT_WORDS), "count")
            .when(any_of(V.MEAN_WORDS), "mean")
            .when(any_of(V.MAX_WORDS), "max")
            .when(any_of(V.MIN_WORDS), "min")
            .otherwise("first")
        )

    return let(all_matches(F.lower(text), UNICODE + rf"\b(?:{every})\b"), choose)
