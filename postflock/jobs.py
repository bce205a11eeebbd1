"""The programs, from text files to text files.

``python -m postflock.jobs NAME ARGUMENT ...`` runs one; ``JOBS`` says which there are
and what their arguments are. Posts are lines ``number \\t user \\t text``; results are
lines of fields between tabs, in as many files as Spark writes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assemble, clean, dataset, features, graph
from .sources import lines

Job = Callable[..., DataFrame]


def _posts(spark: SparkSession, path: str) -> DataFrame:
    return lines.read_posts(spark, path)


def _back(posts: DataFrame) -> DataFrame:
    return posts.select("ts", "user_name", "text")


def _stat(*names: str) -> Job:
    return lambda s, source: features.text_features(_posts(s, source), *names)


def _links(kind: str, function: Callable) -> Job:
    return lambda s, users, source: function(graph.edges(_posts(s, source), kind), lines.read_dict(s, users))


def _ego(direction: str) -> Job:
    return lambda s, adjacency: graph.ego_stats(lines.parse_adjacency(lines.read_lines(s, adjacency)), direction)


def _near(kind: str) -> Job:
    def job(s, users, degrees, source):
        return graph.neighbour_stats(graph.edges(_posts(s, source), kind), lines.read_dict(s, users), lines.parse_link_stats(lines.read_lines(s, degrees)))

    return job


def _filter(s, terms, source):
    return clean.clean_posts(_posts(s, source), lines.read_dict(s, terms, name="term"))


def _dictionary(s, stopwords, least, source):
    return clean.term_dictionary(_posts(s, source), lines.read_dict(s, stopwords, name="term"), int(least))


#: Name -> (arguments before the last, which is where lines go; the job).
JOBS: dict[str, tuple[str, Job]] = {
    "clean_posts": ("terms posts", _filter),
    "clean_posts_without_terms": ("posts", lambda s, source: clean.clean_posts(_posts(s, source))),
    "term_dictionary": ("stopwords least posts", _dictionary),
    "sort_terms": ("counts", lambda s, source: clean.sort_terms(lines.parse_pairs(lines.read_lines(s, source), "cf", "bigint", "term"))),
    "sort_posts": ("posts", lambda s, source: _back(dataset.sort_posts(_posts(s, source), total=True))),
    "count_user": ("least posts", lambda s, least, source: dataset.count_users(_posts(s, source), int(least))),
    "active_users_posts": ("least posts", lambda s, least, source: _back(dataset.active_users_posts(_posts(s, source), int(least)))),
    "posts_of": ("users posts", lambda s, users, source: _back(dataset.posts_of(_posts(s, source), lines.read_dict(s, users)))),
    "sample_users": ("total select posts", lambda s, total, select, source: _back(dataset.sample_users(_posts(s, source), int(total), int(select)))),
    "merge_posts": ("posts", lambda s, source: dataset.merge_posts(_posts(s, source))),
    "merge_posts_of": ("users posts", lambda s, users, source: dataset.merge_posts_of(_posts(s, source), lines.read_dict(s, users, at_space=True))),
    "posts_about": ("user posts", lambda s, user, source: _back(dataset.posts_about(_posts(s, source), user))),
    "text_features": ("posts", _stat()),
    "retweet_counts": ("users posts", lambda s, users, source: features.retweet_counts(_posts(s, source), lines.read_dict(s, users)).select("user_name", "hash", "n", "sample")),
    "sort_features": ("features", lambda s, source: lines.read_lines(s, source).withColumn("user_name", F.split("value", "\t", 2)[0]).transform(assemble.sort_features).select("value")),
    "ego_out": ("adjacency", _ego("out")),
    "ego_in": ("adjacency", _ego("in")),
}
JOBS |= {f"{x}_stat": ("posts", _stat(x)) for x in (*features.COUNTS, *features.FLAGS)}
for _kind in ("mention", "retweet"):
    JOBS |= {
        f"{_kind}_out": ("users posts", _links(_kind, graph.out_neighbours)),
        f"{_kind}_in": ("users posts", _links(_kind, graph.in_neighbours)),
        f"{_kind}_link_stats": ("users posts", _links(_kind, graph.link_stats)),
        f"{_kind}_neighbour_stats": ("users degrees posts", _near(_kind)),
    }


def run(spark: SparkSession, name: str, arguments: list[str]) -> None:
    """Runs a job: its arguments, and then the folder that its lines are written to."""
    wanted, job = JOBS[name]
    if len(arguments) != len(wanted.split()) + 1:
        raise ValueError(f"{name} takes: {wanted} output")
    *given, target = arguments
    lines.write_lines(job(spark, *given), target)


if __name__ == "__main__":
    if len(sys.argv) < 2 or sys.argv[1] not in JOBS:
        sys.exit("\n".join(f"{name} {wanted} output" for name, (wanted, _) in JOBS.items()))
    run(SparkSession.builder.getOrCreate(), sys.argv[1], sys.argv[2:])
