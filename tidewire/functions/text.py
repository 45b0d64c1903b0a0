"""String cleaning, tokenising and simple summaries, all as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.core import ColumnLike, as_col

# Stop words of the tokenizer.
STOPWORDS = (
    "기자", "뉴스", "앵커", "리포트", "보도", "지난", "오늘", "내일", "관련", "대해",
    "이번", "경우", "위해", "통해", "때문", "사진", "출처", "제공", "연합뉴스", "무단",
    "전재", "배포", "금지", "댓글", "구독", "좋아요", "저작권", "일보", "신문",
)
# Words that never count as a topic of a headline.
TOPIC_STOPWORDS = ("시사", "스페셜", "단독", "종합", "속보", "뉴스", "기자", "게시판")
# Interface noise inside author names.
MEMO_NOISE = r"(?i)(메모\s*\d*\s*입력.*|메모하기.*|\d+입력.*|작성자\s*메모.*)"
NAME_AFFIXES = r"(\s*님$|^작성자\s*[:：]\s*|^글쓴이\s*[:：]\s*)"
# Headline counter, view counter, flexible date.
TITLE_COUNTER = r"\s*\[?\d+\]?\s*$"
VIEW_COUNT = r"(?i)(?:조회\s*수?|views?|hit)?\s*[:：]?\s*([\d,]+)"
VIEW_LABEL = "조회"
VIEW_MAX_DIGITS = 7
DATE_PARTS = (
    r"(\d{4})[-./년\s]+(\d{1,2})[-./월\s]+(\d{1,2})일?"
    r"(?:[^\d\n]*(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?"
)
BASIC_ISO = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?)?$"

EDGE_SPACE = r"^\s+|\s+$"


def strip(c: ColumnLike) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_col(c), EDGE_SPACE, "")


def tokenize(text: ColumnLike, min_len: int = 2, stopwords: Iterable[str] = (), base: Iterable[str] = STOPWORDS) -> Column:
    """Runs of letters and digits of at least ``min_len`` characters, in order, without stop words.

    Repeats are kept. A morphological analyser can replace this with any ``Column -> Column`` function.
    """
    words = F.regexp_extract_all(as_col(text), F.lit(rf"([\p{{L}}\p{{N}}]{{{int(min_len)},}})"), F.lit(1))
    drop = sorted({*base, *stopwords})
    return F.filter(words, lambda w: ~w.isin(drop)) if drop else words


def _halve(c: Column, min_half: int) -> Column:
    half = (F.length(c) / 2).cast("int")
    same = (F.length(c) % 2 == 0) & (half >= min_half) & (c.substr(F.lit(1), half) == c.substr(half + 1, half))
    return F.when(same, c.substr(F.lit(1), half)).otherwise(c)


def collapse_repeat(c: ColumnLike) -> Column:
    """Remove interface noise from a name and fold a doubled name ("abcabc") into one."""
    clean = strip(F.regexp_replace(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), MEMO_NOISE, ""), NAME_AFFIXES, ""))
    return strip(_halve(_halve(clean, 1), 2))


def clean_title(c: ColumnLike) -> Column:
    """Drop a trailing reply counter and squeeze white space."""
    return strip(F.regexp_replace(F.regexp_replace(as_col(c), TITLE_COUNTER, ""), r"\s+", " "))


def parse_views(candidates: ColumnLike) -> Column:
    """View count from an array of texts.

    The first labelled or short number wins; when there is none, the last number found.
    """
    found = F.filter(
        F.transform(
            as_col(candidates),
            lambda s: F.struct(F.regexp_extract(s, VIEW_COUNT, 1).alias("n"), F.contains(s, F.lit(VIEW_LABEL)).alias("labelled")),
        ),
        lambda m: m["n"] != "",
    )
    sure = F.filter(found, lambda m: m["labelled"] | (F.length(m["n"]) <= VIEW_MAX_DIGITS))
    pick = F.coalesce(F.get(sure, F.lit(0)), F.try_element_at(found, F.lit(-1)))
    return F.regexp_replace(pick["n"], ",", "").try_cast("long")


def _assemble(groups: list[Column]) -> Column:
    """A timestamp from year, month, day, hour, minute and second texts; empty time parts are zero."""
    y, mo, d, h, mi, s = (F.when(g == "", F.lit("0")).otherwise(g) for g in groups)
    text = F.concat(
        F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")),
        F.lit(" "),
        F.concat_ws(":", F.lpad(h, 2, "0"), F.lpad(mi, 2, "0"), F.lpad(s, 2, "0")),
    )
    return text.try_cast("timestamp_ntz")


def parse_flexible_date(c: ColumnLike) -> Column:
    """Year-month-day with many separators and an optional clock time, else basic ISO, else null."""
    c = strip(c)
    free = _assemble([F.regexp_extract(c, DATE_PARTS, i) for i in range(1, 7)])
    basic = _assemble([F.regexp_extract(c, BASIC_ISO, i) for i in range(1, 7)])
    return F.coalesce(free, basic)


def extractive_summary(content: ColumnLike, fallback: ColumnLike, lines: int = 3, min_chars: int = 15) -> Column:
    """The first lines longer than ``min_chars``, numbered; ``fallback`` when there is none."""
    kept = F.filter(F.transform(F.split(F.coalesce(as_col(content), F.lit("")), "\n"), strip), lambda l: F.length(l) > min_chars)
    numbered = F.transform(F.slice(kept, 1, lines), lambda l, i: F.concat((i + 1).cast("string"), F.lit(". "), l))
    return F.when(F.size(kept) > 0, F.array_join(numbered, "\n")).otherwise(as_col(fallback))


def headline_topics(title: ColumnLike, n: int = 5) -> Column:
    """The first ``n`` words of a headline that are not on the topic stop list."""
    words = F.regexp_extract_all(as_col(title), F.lit("([가-힣a-zA-Z0-9]{2,})"), F.lit(1))
    return F.slice(F.filter(words, lambda w: ~w.isin(list(TOPIC_STOPWORDS))), 1, n)
