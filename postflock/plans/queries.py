"""One query for each operator, on the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur32_of, murmur64_of
from ..functions.stem import porter_stem, stem
from ..operators import assemble, clean, cluster, dataset, features, graph
from .. import jobs
from ..sources import lines
from ..sources.staging import new_folder, settled, stage
from . import fixtures as X

LEAST_CF, LEAST_POSTS = 5, 75
#: Users with so many events are listed for export, and have a score.
LISTED, SCORED = 70, 60
SELECT, TOTAL, SEED = 3, 10, 7
USER = " U17 "
MATRIX = ["word_sum", "char_sum", "hashtag_sum", "retweet_sent_count", "word_avg", "url_avg"]
FLAGGED = ["word_sum", "word_avg", "hashtag_sum"]
OTHERS = ["char_var", "url_avg", "original_ratio"]
TOP = 5


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.text_features(X.posts(spark, sf_dir))


def _terms(spark, sf_dir):
    return clean.term_dictionary(X.posts(spark, sf_dir), X.stopwords(spark), LEAST_CF)


def _edges(kind):
    """Links of a graph, counted and written: texts are read once."""
    return lambda spark, sf_dir: stage(graph.count_links(graph.edges(X.posts(spark, sf_dir), kind)), "edges")


def _neighbours(kind, function):
    @settled("neighbours")
    def query(spark, sf_dir):
        rows = function(_edges(kind)(spark, sf_dir), X.users(spark, sf_dir))
        return rows.select("user_name", "n", F.array_join("nbrs", " ").alias("nbrs"))

    return query


def _links(kind):
    return settled("links")(lambda spark, sf_dir: graph.link_stats(_edges(kind)(spark, sf_dir), X.users(spark, sf_dir)))


def _near(kind):
    @settled("near")
    def query(spark, sf_dir):
        e, u = _edges(kind)(spark, sf_dir), stage(X.users(spark, sf_dir), "users")
        known = stage(graph.counted_links(e, u), "known")
        rows = graph.neighbour_stats(e, u, graph.link_stats(e, u, known), known)
        return rows.select("user_name", *[F.nanvl(c, F.lit(0.0)).alias(c) for c in rows.columns[1:]])

    return query


def _ego(kind, direction):
    way = graph.out_neighbours if direction == "out" else graph.in_neighbours
    return settled("ego")(lambda spark, sf_dir: graph.ego_stats(stage(way(_edges(kind)(spark, sf_dir), X.users(spark, sf_dir)), "adjacency"), direction))


def _features(*names):
    return lambda spark, sf_dir: features.text_features(X.posts(spark, sf_dir), *names)


def _completed(spark, sf_dir):
    """Features of posts with a doubled marker: some users have none."""
    own = dataset.posts_of(X.posts(spark, sf_dir), X.users(spark, sf_dir)).where("contains(text, 'RT RT')")
    return assemble.complete(X.users(spark, sf_dir), features.text_features(own))


def _matrix(spark, sf_dir):
    ids = assemble.lookup(X.users(spark, sf_dir), X.scores(spark, sf_dir), "global_id")
    return _completed(spark, sf_dir).join(ids, "user_name")


def _listed(spark, sf_dir):
    """Some users, in an order of their own."""
    often = X.scores(spark, sf_dir).where(F.col("n_events") >= LISTED).select("user_name", F.col("global_id").alias("at"))
    return X.users(spark, sf_dir).join(often, "user_name")


def _assigned(spark, sf_dir):
    """Embeddings in whole thousandths, so that sums are exact."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("label").alias("cluster_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("features"))


def _stats(spark, sf_dir):
    return cluster.feature_stats(_assigned(spark, sf_dir)).select("cluster_id", "col", "n", "low", "high", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


def _ranked(spark, sf_dir):
    return X.scores(spark, sf_dir).join(X.clusters(spark, sf_dir), "user_name")


@settled("wide")
def _wide(spark, sf_dir):
    """The whole chain: text, links, neighbours and ego networks of each user. Posts,
    users and links are written once each, as several tables come from them."""
    p, u = stage(X.posts(spark, sf_dir), "posts"), stage(X.users(spark, sf_dir), "users")
    tables = [features.text_features(p)]
    for kind in ("mention", "retweet"):
        e = stage(graph.count_links(graph.edges(p, kind)), "edges")
        known = stage(graph.counted_links(e, u), "known")
        links = stage(graph.link_stats(e, u, known), "links")
        near = graph.neighbour_stats(e, u, links, known)
        near = near.select("user_name", *[F.nanvl(c, F.lit(0.0)).alias(c) for c in near.columns[1:]])
        ego = graph.ego_stats(stage(graph.out_neighbours(e, u, known), "neighbours"))
        tables += [t.select("user_name", *[F.col(c).alias(f"{kind}_{c}") for c in t.columns if c != "user_name"]) for t in (links, near, ego)]
    return assemble.combine(u, *tables)


def _count_user_text(spark, sf_dir):
    """Posts as lines of text in, users and counts as lines of text out."""
    source, target = new_folder(spark, "posts"), new_folder(spark, "counts")
    lines.write_lines(X.posts(spark, sf_dir), source)
    jobs.run(spark, "count_user", [str(LEAST_POSTS), source, target])
    return lines.parse_pairs(spark.read.text(target), "n_posts", "bigint")


def _words(spark, sf_dir):
    return clean.raw_terms(X.posts(spark, sf_dir)).where("word IS NOT NULL").select("word").distinct()


QUERIES = {
    "tweet_filter": lambda s, d: clean.clean_posts(X.posts(s, d), _terms(s, d)),
    "tweet_filter_nodict": lambda s, d: clean.clean_posts(X.posts(s, d)),
    "tweet_dict": _terms,
    "dict_sort": lambda s, d: clean.sort_terms(clean.term_counts(X.posts(s, d))),
    "stem": lambda s, d: _words(s, d).select("word", stem(F.col("word")).alias("stem")),
    "sort_posts": lambda s, d: dataset.sort_posts(X.posts(s, d), total=True),
    "count_user_text": _count_user_text,
    "count_user": lambda s, d: dataset.count_users(X.posts(s, d), LEAST_POSTS),
    "filter_less_user": lambda s, d: dataset.active_users_posts(X.posts(s, d), LEAST_POSTS),
    "sample_by_user": lambda s, d: dataset.posts_of(X.posts(s, d), X.users(s, d)),
    "sample_random": lambda s, d: dataset.sample_users(X.posts(s, d), TOTAL, SELECT, SEED),
    "merge_posts": lambda s, d: dataset.merge_posts(X.posts(s, d)),
    "merge_posts_by_user": lambda s, d: dataset.merge_posts_of(X.posts(s, d), X.users(s, d)),
    "relevant_user": lambda s, d: dataset.posts_about(X.posts(s, d), USER),
    "text_features": entry,
    "word_stat": _features("word"),
    "char_stat": _features("char"),
    "hashtag_stat": _features("hashtag"),
    "url_stat": _features("url"),
    "mention_sent_stat": _features("mention_sent"),
    "retweet_sent_stat": _features("retweet_sent"),
    "original_stat": _features("original"),
    "retweet_num_per_tweet": lambda s, d: features.retweet_counts(X.posts(s, d), X.users(s, d)),
    "egonet_dump": lambda s, d: graph.ego_dump(stage(graph.out_neighbours(_edges("mention")(s, d), X.users(s, d)), "adjacency")),
    "feature_sort": lambda s, d: assemble.sort_features(_features("word")(s, d)),
    "feature_complete": _completed,
    "feature_wide": _wide,
    "feature_normalize": lambda s, d: assemble.normalise(_matrix(s, d), FLAGGED, OTHERS),
    "export_cluster": lambda s, d: assemble.export_cluster(_completed(s, d), _listed(s, d), "at", MATRIX, 100),
    "export_lda": lambda s, d: assemble.export_lda(_completed(s, d), _listed(s, d), "at", MATRIX),
    "export_random": lambda s, d: assemble.export_random(X.users(s, d), 4, SEED),
    "local_user_map": lambda s, d: assemble.lookup(X.users(s, d), X.scores(s, d).where(F.col("n_events") >= SCORED), "global_id"),
    "local_user_pr": lambda s, d: assemble.lookup(X.users(s, d), X.scores(s, d).where(F.col("n_events") >= SCORED), "pr"),
    "cluster_feature_stat": _stats,
    "cluster_select_parse": lambda s, d: cluster.parse_report(X.report(s)),
    "cluster_selected_stat": lambda s, d: cluster.selected_stats(_stats(s, d), cluster.parse_report(X.report(s))),
    "cluster_top_users": lambda s, d: cluster.top_users(_ranked(s, d), TOP),
    "murmur64": lambda s, d: _words(s, d).select("word", murmur64_of("word").alias("hash")),
    "murmur32": lambda s, d: _words(s, d).select("word", murmur32_of("word").alias("hash")),
    "porter_full": lambda s, d: _words(s, d).select("word", porter_stem("word").alias("stem")),
}
for _kind in ("mention", "retweet"):
    QUERIES |= {
        f"{_kind}_outlink": _neighbours(_kind, graph.out_neighbours),
        f"{_kind}_inlink": _neighbours(_kind, graph.in_neighbours),
        f"{_kind}_link_stat": _links(_kind),
        f"{_kind}_subnet": _near(_kind),
        f"{_kind}_out_egonet": _ego(_kind, "out"),
        f"{_kind}_in_egonet": _ego(_kind, "in"),
    }
# two of the programs are copies of others
QUERIES |= {"retweet_internal_outlink_dict": QUERIES["tweet_dict"], "sort_posts_old": QUERIES["sort_posts"]}
