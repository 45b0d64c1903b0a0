"""Term counts, term pairs and queries on the keyword graph."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.core import as_col, full_text, round_half_up, ts_literal
from tidewire.functions.text import tokenize
from tidewire.operators.pair_tiles import pair_counts


def tokenize_articles(articles: DataFrame, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """doc_id, source_id and the token list of title plus content."""
    return articles.select(F.col("id").alias("doc_id"), "source_id", tokenizer(full_text("title", "content")).alias("tokens"))


def counted_terms(tokens: DataFrame, *keys: str) -> DataFrame:
    """One row per token and one more per distinct token of its document; ``in_text`` tells them apart.

    Counting the first kind gives the frequency, counting the second the document count: both in one aggregation,
    without a second shuffle for the distinct count and without sorting.
    """
    both = F.concat("tokens", F.array_distinct("tokens"))
    # an outer generator: a plain one would infer a filter on the array and compute the tokens twice
    rows = tokens.select(*keys, F.size("tokens").alias("n"), F.posexplode_outer(both).alias("pos", "term")).where(F.col("term").isNotNull())
    return rows.select(*keys, "term", (F.col("pos") < F.col("n")).alias("in_text"))


def counts_in_text(tokens: DataFrame, *keys: str) -> DataFrame:
    """One row per document and distinct term with its frequency there: the runs of the sorted tokens. Nothing is shuffled."""
    at = lambda i: F.get("sorted", i)
    places = F.when(F.size("sorted") > 0, F.sequence(F.lit(0), F.size("sorted") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | ~at(i).eqNullSafe(at(i - 1)))
    runs = F.transform("starts", lambda x, k: F.struct(at(x).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("sorted")) - x).cast("long").alias("frequency")))
    rows = tokens.select(*keys, F.sort_array("tokens").alias("sorted")).select(*keys, "sorted", starts.alias("starts"))
    return rows.select(*keys, F.inline_outer(runs)).where(F.col("term").isNotNull())  # outer, as in ``counted_terms``


def term_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """frequency and doc_count per term in one shuffle with partial sums."""
    return counted_terms(tokens, *keys).groupBy(*keys, "term").agg(
        F.count_if("in_text").alias("frequency"), F.count_if(~F.col("in_text")).alias("doc_count")
    )


def term_frequency(tokens: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most frequent terms with total and document counts (A1); ties by term."""
    return term_counts(tokens).orderBy(F.desc("frequency"), "term").limit(n)


def term_frequency_by_source(tokens: DataFrame, n: int = 100) -> DataFrame:
    """A1 for every source. The rank filter is applied before the shuffle too, so a dominant source stays cheap."""
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("frequency"), "term"))
    return term_counts(tokens, "source_id").withColumn("rank", rank).where(F.col("rank") <= n)


def term_rows(tokens: DataFrame, at: Column | str, n: int = 100) -> DataFrame:
    """Rows of the term time series: time, source_id, term, frequency, doc_count."""
    return term_frequency_by_source(tokens, n).select(as_col(at).alias("time"), "source_id", "term", "frequency", "doc_count")


def document_frequency(tokens: DataFrame) -> DataFrame:
    terms = tokens.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count("*").alias("docs"))


#: Terms in a block of a document's term set.
BLOCK_TERMS = 128


def block_pairs(sets: DataFrame, size: int = BLOCK_TERMS) -> DataFrame:
    """Rows (n, left, right) from rows (n, terms): each sorted term set cut into blocks of ``size``, and every block paired with itself and with those after it.

    Sets of one block stay where they are. The block pairs of larger ones are dealt out one by one, so that a very long document is spread over tasks like many short ones; the terms dealt are
    as many as the document's pairs over half a block.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("terms") - 1) / size).cast("int")), lambda k: F.slice("terms", k * size + 1, size))
    small = sets.where((F.size("terms") > 1) & (F.size("terms") <= size)).select("n", F.col("terms").alias("left"), F.col("terms").alias("right"))
    large = sets.where(F.size("terms") > size).select("n", blocks.alias("blocks"))
    lefts = large.select("n", "blocks", F.posexplode("blocks").alias("i", "left"))
    pairs = lefts.select("n", "left", F.explode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("right"))
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: adaptive execution would put these few bytes, and all their pairs, into one task
    return small.unionByName(pairs.repartition(tasks, F.xxhash64("left", "right")))


def _pair_counts(sets: DataFrame, min_count: int, size: int = BLOCK_TERMS) -> DataFrame:
    """Pair counts from one sorted term set per document.

    Documents with the same set are merged first, so a large group of copies is expanded once. The pairs of two blocks leave the generator together and are summed on the map side before the
    shuffle on (src, dst).
    """
    merged = sets.groupBy("terms").agg(F.count("*").alias("n"))
    pair = lambda x: F.transform(F.filter("right", lambda y: y > x), lambda y: F.struct(x.alias("src"), y.alias("dst")))
    pairs = block_pairs(merged, size).select("n", F.inline(F.flatten(F.transform("left", pair))))
    return pairs.groupBy("src", "dst").agg(F.sum("n").alias("weight")).where(F.col("weight") >= min_count)


def cooccurrence_within(tokens: DataFrame, vocabulary: DataFrame, min_count: int = 2) -> DataFrame:
    """Document counts of the pairs of a short vocabulary (A2, J10): src < dst, weight >= min_count.

    ``vocabulary`` is a bounded list such as the result of ``term_frequency``. It enters as one array value, and the
    documents are cut down to it where they are read, before anything is shuffled.
    """
    wanted = vocabulary.agg(F.collect_list("term").alias("v")).scalar()
    return _pair_counts(tokens.select(F.sort_array(F.array_intersect("tokens", wanted)).alias("terms")), min_count)


#: Parts of the terms in a stored table of edges, which has a place for each two of them.
EDGE_PARTS = 11


def cooccurrence_with_ends(tokens: DataFrame, min_count: int = 2, vocabulary: DataFrame | None = None, step: int = 1) -> DataFrame:
    """``cooccurrence`` with the document counts of both terms: n_src and n_dst. One job counts the pairs when it is called; ``tokens`` has one row per document."""
    size = F.size(F.array_distinct("tokens")).cast("long")
    pairs = tokens.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    distinct = tokens.select("doc_id", F.explode_outer(F.array_distinct("tokens")).alias("term")).where(F.col("term").isNotNull())
    kept = distinct.groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_count)
    kept = kept if vocabulary is None else kept.join(vocabulary, "term", "left_semi")
    return pair_counts(distinct, kept, int(pairs), min_count, step=step).select("src", "dst", "weight", "n_src", "n_dst")


def cooccurrence(tokens: DataFrame, min_count: int = 2, vocabulary: DataFrame | None = None, step: int = 1) -> DataFrame:
    """Document counts of all term pairs (A2, J10), or of those of a ``vocabulary`` of any length.

    A pair is never more frequent than its rarer term, so terms in fewer than ``min_count`` documents are dropped
    before pairing; the result is unchanged. With ``step`` EDGE_PARTS a task forms edges of one place of a stored table, if there are many.
    """
    return cooccurrence_with_ends(tokens, min_count, vocabulary, step).select("src", "dst", "weight")


def cooccurrence_of_both(tokens: DataFrame, batch: DataFrame, min_count: int = 2) -> DataFrame:
    """``cooccurrence`` of two sets of documents, which may overlap, with an edge's two weights in one row: ``weight`` in ``tokens``, ``batch_weight`` in ``batch``; null if it is no edge there.

    Both weights of an edge are counted in one tile, so that a merge of the two edge tables (K6, K6b) needs no join. One job counts the pairs when it is called.
    """
    both = [t.select(F.lit(k).alias("period"), "doc_id", F.array_distinct("tokens").alias("terms")) for k, t in enumerate((tokens, batch))]
    size = F.size("terms").cast("long")
    pairs = both[0].unionByName(both[1]).agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    held = [t.select("period", "doc_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull()) for t in both]
    distinct = held[0].unionByName(held[1])
    kept = distinct.groupBy("term").agg(*[F.count_if(F.col("period") == k).alias(n) for k, n in enumerate(("docs", "batch_docs"))])
    kept = kept.where((F.col("docs") >= min_count) | (F.col("batch_docs") >= min_count)).select("term", F.greatest("docs", "batch_docs").alias("docs"))
    return pair_counts(distinct, kept, int(pairs), min_count, ("weight", "batch_weight")).select("src", "dst", "weight", "batch_weight")


def _with_ends(edges: DataFrame, docs: DataFrame | None) -> DataFrame:
    if docs is None:  # cooccurrence_with_ends has them
        return edges
    ni = docs.select(F.col("term").alias("src"), F.col("docs").alias("n_src"))
    nj = docs.select(F.col("term").alias("dst"), F.col("docs").alias("n_dst"))
    return edges.join(ni, "src").join(nj, "dst")


def cooccurrence_weight(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """N_ij / sqrt(N_i * N_j) on top of pair counts (A3)."""
    weight = F.col("weight") / F.sqrt(F.col("n_src").cast("double") * F.col("n_dst"))
    return _with_ends(edges, docs).select("src", "dst", F.col("weight").alias("co_count"), round_half_up(weight, 6).alias("weight"))


def jaccard_weight(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """N_ij / (N_i + N_j - N_ij) on top of pair counts."""
    weight = F.col("weight").cast("double") / (F.col("n_src") + F.col("n_dst") - F.col("weight"))
    return _with_ends(edges, docs).select("src", "dst", F.col("weight").alias("co_count"), round_half_up(weight, 6).alias("weight"))


#: Buckets of the coarsest grain in a chunk of a term's time.
CHUNK_BUCKETS = 128
#: Minutes of a fine bucket, an hour and a day.
GRAINS = (10, 60, 1440)


def term_rollup(term_rows: DataFrame, minutes: int = 10) -> DataFrame:
    """Frequency per term and time bucket, with the change against the bucket just before it (A4)."""
    return term_rollups(term_rows, (minutes,)).drop("minutes")


def term_rollups(term_rows: DataFrame, grains: tuple[int, ...] = GRAINS) -> DataFrame:
    """A4 at several grains, each a multiple of the one before.

    The rows are shuffled once, by term and chunk of time, and summed and compared there at all grains. A chunk also gets the last coarse bucket of the chunk before it, so that its first
    bucket finds the one just before; a frequent term is as many groups as it has chunks.
    """
    for k, minutes in enumerate(grains):
        if minutes % grains[max(0, k - 1)]:
            raise ValueError(f"{minutes} minutes are no multiple of {grains[k - 1]}")
    span = CHUNK_BUCKETS * grains[-1]
    later = lambda c, minutes: F.col(c) + F.make_dt_interval(mins=F.lit(minutes))
    rows = term_rows.select("term", F.window("time", f"{grains[0]} minutes")["start"].alias("at"), "frequency")
    rows = rows.select("term", "at", "frequency", F.window("at", f"{span} minutes")["start"].alias("chunk"))
    at_end = F.col("at") >= later("chunk", span - grains[-1])
    chunks = F.when(at_end, F.array(F.col("chunk"), later("chunk", span))).otherwise(F.array("chunk"))
    rows = rows.select("term", "at", "frequency", F.explode(chunks).alias("chunk")).repartition("term", "chunk")
    for minutes in grains:
        rows = rows.select("*", F.window("at", f"{minutes} minutes")["start"].alias(f"at_{minutes}"))
    rows = rows.select("term", "chunk", "frequency", F.inline(F.array(*[F.struct(F.lit(m).alias("minutes"), F.col(f"at_{m}").alias("bucket")) for m in grains])))
    sums = rows.groupBy("term", "chunk", "minutes", "bucket").agg(F.sum("frequency").alias("frequency"))
    w = W.partitionBy("term", "chunk", "minutes").orderBy("bucket")
    before = F.when(F.timestamp_diff("MINUTE", F.lag("bucket").over(w), F.col("bucket")) == F.col("minutes"), F.lag("frequency").over(w)).otherwise(F.lit(0))
    rolled = sums.withColumn("previous", before).where(F.col("bucket") >= F.col("chunk"))
    return rolled.select("term", "bucket", "frequency", "previous", (F.col("frequency") - F.col("previous")).alias("change"), "minutes")


def term_series(term_rows: DataFrame, term: str, as_of, hours: int = 24) -> DataFrame:
    """The recent rows of one term, oldest first."""
    start = ts_literal(as_of) - F.make_dt_interval(hours=F.lit(hours))
    rows = term_rows.where((F.col("term") == term) & (F.col("time") >= start))
    rows = rows.where(F.col("dt") >= F.to_date(start)) if "dt" in term_rows.columns else rows  # the stored layout drops whole days
    return rows.orderBy("time", "source_id")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, for undirected walks; one pass over the edges."""
    there = F.struct("src", "dst", "weight")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select(F.inline(F.array(there, back)))


def neighbors(edges: DataFrame, keyword: str, n: int = 30) -> DataFrame:
    """The heaviest edges at one keyword in either direction (J8): one filtered pass over the edges."""
    at_src = F.col("src") == keyword
    return (
        edges.where(at_src | (F.col("dst") == keyword))
        .select(F.lit(keyword).alias("source"), F.when(at_src, F.col("dst")).otherwise(F.col("src")).alias("target"), "weight")
        .orderBy(F.desc("weight"), "target")
        .limit(n)
    )


def top_edges(edges: DataFrame, n: int = 30) -> DataFrame:
    """The heaviest edges (T3); ties by name."""
    return edges.select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst").limit(n)


#: Most frequent terms whose pairs give a first bound on the heaviest edges.
POOL = 100


def nth_weight(edges: DataFrame, n: int, least: int = 2) -> int:
    """Weight of the ``n``-th heaviest edge, ``least`` if there are fewer."""
    heaviest = edges.orderBy(F.desc("weight")).limit(n)
    count, weight = heaviest.agg(F.count("*"), F.min("weight")).first()
    return max(least, weight) if count == n else least


def top_edges_of(tokens: DataFrame, n: int = 30, min_count: int = 2) -> DataFrame:
    """``top_edges`` of the whole graph of ``tokens``, without building it.

    The n-th heaviest edge among the most frequent terms is a lower bound for the n-th of all; an edge never outweighs its rarer term, so terms in fewer documents than that bound cannot be on
    a heavier edge and are left out before pairing. The result is exact.
    """
    bound = nth_weight(cooccurrence_within(tokens, term_frequency(tokens, POOL), min_count), n, min_count)
    return top_edges(cooccurrence(tokens, bound), n)


def links_of(tokens: DataFrame, keywords: DataFrame, min_count: int = 2) -> DataFrame:
    """The edges at some keywords (rows ``term``; a short list), each with a keyword as src: as ``both_ways`` of the whole graph has them.

    Only documents that hold a keyword are expanded, each to its own terms; no pair without a keyword is formed.
    """
    wanted = keywords.agg(F.collect_set("term").alias("v")).scalar()
    held = tokens.select(F.array_distinct("tokens").alias("terms"), wanted.alias("wanted"))
    at = held.select("terms", F.explode(F.array_intersect("terms", "wanted")).alias("src"))
    pairs = at.select("src", F.explode("terms").alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_count)


def _keyword(tokens: DataFrame, keyword: str) -> DataFrame:
    return tokens.sparkSession.range(1).select(F.lit(keyword).alias("term"))


def neighbors_of(tokens: DataFrame, keyword: str, n: int = 30, min_count: int = 2) -> DataFrame:
    """``neighbors`` in the whole graph of ``tokens`` (J8), from the documents that hold the keyword."""
    return neighbors(links_of(tokens, _keyword(tokens, keyword), min_count), keyword, n)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct ends of an edge list (U4).

    Edges are read heaviest first, source before target; a node first met as a source is group 1, else group 2.
    """
    key = (-F.col("weight")).alias("w")
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("name"), F.struct(key, F.col("src"), F.col("dst"), F.lit(0).alias("role")).alias("seen")),
                F.struct(F.col("dst").alias("name"), F.struct(key, F.col("src"), F.col("dst"), F.lit(1).alias("role")).alias("seen")),
            )
        )
    )
    first = ends.groupBy("name").agg(F.min("seen").getField("role").alias("role"))
    return first.select("name", (F.col("role") + 1).alias("group"), F.when(F.col("role") == 0, 15.0).otherwise(10.0).alias("size"))


def topic_expand(edges: DataFrame, center: str, n: int = 8, depth: int = 1) -> DataFrame:
    """Terms around a topic (M10): the ``n`` heaviest neighbours of every term reached, one join per level.

    The frontier has at most n**depth terms. A term keeps its first level and, there, its heaviest edge.
    """
    links = both_ways(edges)
    return _expand(neighbors(edges, center, n), lambda terms: links.join(terms.withColumnRenamed("term", "src"), "src", "left_semi"), center, n, depth)


def topic_expand_of(tokens: DataFrame, center: str, n: int = 8, depth: int = 1, min_count: int = 2) -> DataFrame:
    """``topic_expand`` in the whole graph of ``tokens``: a level counts only the edges at its frontier."""
    return _expand(neighbors_of(tokens, center, n, min_count), lambda terms: links_of(tokens, terms, min_count), center, n, depth)


def _expand(first: DataFrame, links_at: Callable[[DataFrame], DataFrame], center: str, n: int, depth: int) -> DataFrame:
    reached = first.select(F.col("target").alias("term"), "weight", F.lit(1).alias("level"))
    frontier = reached
    for level in range(2, depth + 1):
        rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
        frontier = (
            links_at(frontier.select("term").distinct())
            .withColumn("r", rank)
            .where((F.col("r") <= n) & (F.col("dst") != center))
            .groupBy(F.col("dst").alias("term"))
            .agg(F.max("weight").alias("weight"))
            .join(reached.select("term"), "term", "left_anti")
            .withColumn("level", F.lit(level))
        )
        reached = reached.unionByName(frontier)
    return reached.select("term", "weight", "level", (F.lit(15.0) + F.col("weight").cast("double") * 2).alias("size"))


def topic_query(expanded: DataFrame, center: str, n: int = 4) -> DataFrame:
    """The search text of a topic: the center and its first related terms joined by OR."""
    first = expanded.where(F.col("level") == 1).orderBy(F.desc("weight"), "term").limit(n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    joined = F.array_join(F.transform(ordered, lambda t: t["term"]), " OR ")
    return first.agg(F.trim(F.concat(F.lit(center + " "), joined)).alias("suggested_query"))


#: Documents of a block, about, whose distinct runs are matched together.
MATCH_DOCS = 4000
_RUN = r"[\p{L}\p{N}]+"


def term_match(docs: DataFrame, terms: DataFrame, center: str) -> DataFrame:
    """Which graph terms occur in title plus summary, ignoring case (J9); none means the center itself. ``docs``: id, title, summary; ids are unique.

    A graph term has letters and digits only, so that it can occur inside a run of them and nowhere else. The distinct runs of all texts are cut into their parts of up to the longest term's
    length, and met with the terms by an equality join. Documents lie in blocks of about ``MATCH_DOCS``; what is shuffled is each block's distinct runs with their terms, not every document's.
    The work is linear in the text, and the list of terms may be of any length. The documents are counted when this is called.
    """
    text = F.lower(full_text(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    wanted = terms.select(F.col("term"), F.lower("term").alias("part")).distinct()
    blocks = max(1, math.ceil(docs.count() / MATCH_DOCS))
    held = docs.select("id", F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_RUN})"), F.lit(1))).alias("runs"))
    held = held.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "runs").repartition("block")
    runs = held.select("block", F.explode("runs").alias("run")).distinct()
    longest = wanted.agg(F.coalesce(F.max(F.length("part")), F.lit(0))).scalar()
    parts_at = lambda i, m: F.transform(F.sequence(F.lit(1), F.least(m, F.length("run") - i + 1)), lambda n: F.substr("run", i, n))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: parts_at(i, F.col("longest"))))
    cut = runs.select("run").distinct().withColumn("longest", longest).where("longest > 0").select("run", F.explode(F.array_distinct(parts)).alias("part"))
    hits = cut.join(wanted, "part").groupBy("run").agg(F.collect_list("term").alias("terms"))
    found = runs.join(hits, "run").select(F.col("block").alias("at"), "run", "terms")

    def match(documents: pa.Table, lists: pa.Table) -> pa.Table:
        by_run = dict(zip(lists["run"].to_pylist(), lists["terms"].to_pylist(), strict=True))
        out = [sorted({term for run in runs for term in by_run.get(run, ())}) or [center] for runs in (row or () for row in documents["runs"].to_pylist())]
        return pa.table({"id": documents["id"], "matched_terms": pa.array(out, pa.list_(pa.string()))})

    kind = docs.schema["id"].dataType.simpleString()
    return held.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(match, f"id {kind}, matched_terms array<string>")
