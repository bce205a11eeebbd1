import math
import random
import re

import pytest

from postflock import jobs

from postflock.operators import assemble, clean, cluster, dataset, features, graph
from postflock.sources import lines


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "user_name string")


def test_rows_without_links_to_known_users(spark):
    e = links(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("c", "x"), ("x", "d"), ("a", "c")])
    u = users(spark, "a", "b", "c", "d", "e")
    out = {r.user_name: (r.n, r.nbrs) for r in graph.out_neighbours(e, u).collect()}
    assert out == {"a": (2, ["b", "c"]), "b": (1, ["a"]), "c": (0, [])}
    assert {r.user_name: r.nbrs for r in graph.in_neighbours(e, u).collect()} == {"a": ["b"], "b": ["a"], "c": ["a"], "d": []}
    stats = {r.user_name: tuple(r)[1:] for r in graph.link_stats(e, u).collect()}
    assert stats["a"] == (1, 2, 0.5, 1, 1.0, 3, 1) and stats["b"] == (1, 1, 1.0, 1, 1.0, 1, 2)
    assert stats["c"] == (0, 0, 0.0, 1, 0.0, 0, 1) and stats["d"] == (0, 0, 0.0, 0, 0.0, 0, 0) and "e" not in stats
    near = {r.user_name: tuple(r)[1:] for r in graph.neighbour_stats(e, u, graph.link_stats(e, u)).collect()}
    assert near["a"] == (0.5, 0.25, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0)
    assert all(math.isnan(x) for x in near["d"]) and math.isnan(near["c"][0]) and near["c"][4:] == (2.0, 0.0, 1.0, 0.0)


def test_ego_networks(spark):
    # y is linked to a, b and c; c has no row of its own
    rows = [("y", 3, ["a", "b", "c"]), ("a", 2, ["b", "y"]), ("b", 1, ["c"]), ("d", 0, [])]
    adjacency = spark.createDataFrame(rows, "user_name string, n long, nbrs array<string>")
    of_y = {(r.src, r.dst) for r in graph.ego_links(adjacency).where("center = 'y'").collect()}
    assert of_y == {("y", "a"), ("y", "b"), ("a", "y"), ("a", "b"), ("b", "c")}
    stats = {r.user_name: tuple(r)[1:] for r in graph.ego_stats(adjacency).collect()}
    assert stats["y"] == pytest.approx((3, 5 / 3, 2 / 9, 4, 1.25, 0.1875)) and "d" not in stats
    mirror = {r.user_name: tuple(r)[1:] for r in graph.ego_stats(adjacency, "in").collect()}
    assert mirror["y"] == stats["y"][3:] + stats["y"][:3]
    dump = [(r.node, r.tag, r.place, r.line) for r in graph.ego_dump(adjacency).where("node = 'b'").orderBy("place").collect()]
    assert dump == [("b", 0, 1, "0 b\t1\tc"), ("b", 1, 2, "1 a\t2\tb\ty"), ("b", 1, 3, "1 y\t3\ta\tb\tc")]


def test_cleaning(spark):
    rows = [(1, "u", "two words"), (2, "u", "@a Meetings, #Tag! http://x #! Example.COM cats"), (3, "u", "@a @b @c"), (4, "v", "same cats same"), (4, "v", "same cats same")]
    posts = spark.createDataFrame(rows, "ts long, user_name string, text string")
    got = sorted((r.ts, r.text) for r in clean.clean_posts(posts).collect())
    assert got == [(2, "meet #tag cat"), (4, "same cat same"), (4, "same cat same")]
    some = spark.createDataFrame([("same",)], "term string")
    assert sorted((r.ts, r.text) for r in clean.clean_posts(posts, some).collect()) == [(2, "#tag"), (4, "same same"), (4, "same same")]
    terms = [tuple(r) for r in clean.term_dictionary(posts, some, 3).collect()]
    assert terms == [("cat", 3), ("#tag", 1)]


def test_originals_without_letters_share_one_bucket(spark):
    posts = spark.createDataFrame([(1, "u", "RT @v 12 34"), (2, "w", "RT @v 56 78"), (3, "x", "RT @v 9999"), (4, "u", "RT @x 9999")], "ts long, user_name string, text string")
    out = [tuple(r) for r in features.retweet_counts(posts, users(spark, "u", "v", "w")).collect()]
    assert out == [("v", "", -7207201254813729732, 2, "56 78")]


def test_lines(spark, tmp_path):
    raw = spark.createDataFrame([(x,) for x in ["1\tu\ta\tb", "2\tu", "no tabs", "", "3\tv\t"]], "value string")
    assert [tuple(r) for r in lines.parse_posts(raw).collect()] == [(1, "u", "a\tb"), (3, "v", "")]
    bad = spark.createDataFrame([("x\tu\ta",), ("1\tu\tb",)], "value string")
    assert [tuple(r) for r in lines.parse_posts(bad, "drop").collect()] == [(1, "u", "b")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        lines.parse_posts(bad).collect()
    names = spark.createDataFrame([("a b\tc",), (" ",), ("a b",)], "value string")
    assert [r[0] for r in lines.parse_dict(names).collect()] == ["a b"] and [r[0] for r in lines.parse_dict(names, True).collect()] == ["a"]
    adjacency = spark.createDataFrame([("u", 2, ["a", "b"]), ("v", 0, [])], "user_name string, n long, nbrs array<string>")
    lines.write_lines(adjacency, f"{tmp_path}/out")
    assert sorted(map(tuple, lines.parse_adjacency(spark.read.text(f"{tmp_path}/out")).collect())) == [("u", 2, ["a", "b"]), ("v", 0, [])]
    pairs = lines.parse_pairs(spark.createDataFrame([("u\t0.5",), ("bad",)], "value string"), "pr", "double")
    assert [tuple(r) for r in pairs.collect()] == [("u", 0.5)]
    with pytest.raises(Exception, match="2 numbers"):
        lines.parse_numbers(spark.createDataFrame([("1 2 3",)], "value string"), 2).collect()


def values(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def test_readers_of_features(spark, tmp_path):
    stats = lines.parse_link_stats(values(spark, "u\t1\t2\t0.5\t4\t0.25\t6\t7", "short\t1\t2\t3", ""))
    assert [tuple(r) for r in stats.collect()] == [("u", 2, 4)]
    table = lines.parse_features(values(spark, "u\t1\t2.5\t", "v\t3\tNaN", ""), ["x", "y"])
    assert [str(tuple(r)) for r in table.collect()] == ["('u', 1.0, 2.5)", "('v', 3.0, nan)"]
    for bad in ("no tab", "u\t1", "u\t1\t2\t3"):
        with pytest.raises(Exception, match="not 2 features"):
            lines.parse_features(values(spark, bad), ["x", "y"]).collect()
    (tmp_path / "flags").write_text("1\n0\n1 yes\n")
    flags = lines.parse_flags(lines.read_ordered(spark, f"{tmp_path}/flags"), ["a", "b", "c", "d"])
    assert [(r.name, r.flag) for r in flags.orderBy("place").collect()] == [("a", True), ("b", False), ("c", True), ("d", False)]
    matrix = lines.parse_matrix(values(spark, "1 u 7 0.5 1.0E7", ""), ["x", "y"])
    assert [tuple(r) for r in matrix.collect()] == [(1, "u", 7, 0.5, 1e7)]
    with pytest.raises(Exception, match="not 2 features"):
        lines.parse_matrix(values(spark, "1 u 7 0.5"), ["x", "y"]).collect()


def test_jobs_from_text_to_text(spark, tmp_path):
    (tmp_path / "posts").write_text("1\tu\ta b @v\n2\tu\tb #x c\n3\tv\tRT @u: hello there\nskipped\n")
    (tmp_path / "users").write_text("u\nv\textra\n")

    def run(name, *arguments):
        jobs.run(spark, name, [*arguments, f"{tmp_path}/out-{name}"])
        return sorted(r.value for r in spark.read.text(f"{tmp_path}/out-{name}").collect())

    posts, people = f"{tmp_path}/posts", f"{tmp_path}/users"
    assert run("count_user", "2", posts) == ["u\t2"]
    assert run("mention_out", people, posts) == ["u\t1\tv"]
    assert run("merge_posts", posts) == ["u\ta b @v b #x c ", "v\tRT @u: hello there "]
    degrees = run("mention_link_stats", people, posts)
    assert degrees == ["u\t0\t1\t0.0\t0\t0.0\t1\t0", "v\t0\t0\t0.0\t1\t0.0\t0\t1"]
    assert run("mention_neighbour_stats", people, f"{tmp_path}/out-mention_link_stats", posts)[0].startswith("u\t0.0\t0.0\t1.0\t0.0\tNaN")
    assert run("retweet_counts", people, posts)[0].split("\t")[2:] == ["1", "hello there"]
    assert run("ego_out", f"{tmp_path}/out-mention_out") == []
    with pytest.raises(ValueError, match="least posts output"):
        jobs.run(spark, "count_user", ["1"])
    with pytest.raises(KeyError):
        jobs.run(spark, "no such job", [])


def test_matrix(spark):
    u = users(spark, "b", "a", "c")
    f = spark.createDataFrame([("a", 4.0, -1.0), ("c", float("nan"), -2.0)], "user_name string, x double, y double")
    done = assemble.complete(u, f)
    assert sorted(map(str, done.collect())) == sorted(map(str, [*done.collect()])) and [r.local_id for r in done.orderBy("user_name").collect()] == [1, 2, 3]
    ids = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9)], "user_name string, global_id long")
    rows = {r.user_name: tuple(r)[2:] for r in assemble.normalise(done.join(ids, "user_name"), ["x", "y"], []).collect()}
    assert rows == {"a": (7, 1.0, 0.0), "b": (8, 0.0, 0.0), "c": (9, 0.0, 0.0)}
    with pytest.raises(Exception, match="not in the dictionary"):
        assemble.complete(users(spark, "a"), f).collect()
    listed = spark.createDataFrame([("zz", 0)], "user_name string, at int")
    with pytest.raises(Exception, match="no features of user zz"):
        assemble.export_lda(done, listed, "at", ["x"]).collect()


def test_printed_rows(spark):
    """Lines as the reference prints them."""
    rows = [(1, "a", 7, 1.0, 1e7), (2, "b", 8, 0.0005, 0.1), (3, "c", 9, 17.333333333333332, 12345678.9)]
    matrix = spark.createDataFrame(rows, "local_id long, user_name string, global_id long, x double, y double")
    listed = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "user_name string, at int")
    lda = [r.line for r in assemble.export_lda(matrix, listed, "at", ["x", "y"]).orderBy("place").collect()]
    assert lda == ["1 f1:5.0E-4 f2:0.1 # b", "1 f1:1.0 f2:1.0E7 # a", "1 f1:17.333333333333332 f2:1.23456789E7 # c"]
    cluster_lines = [r.line for r in assemble.export_cluster(matrix, listed, "at", ["x", "y"], 3).orderBy("place").collect()]
    assert cluster_lines == ["3 2", "5.0E-4 0.1", "1.0 1.0E7", "17.333333333333332 1.23456789E7"]
    drawn = sorted(r.line for r in assemble.export_random(listed, 2, 5).collect())
    assert sorted(re.sub(r"0\.\d+(E-\d)?|\d\.\d+E-\d", "r", x) for x in drawn) == ["1 x1:r x2:r # a", "1 x1:r x2:r # b", "1 x1:r x2:r # c"]
    assert drawn == sorted(r.line for r in assemble.export_random(listed.repartition(3), 2, 5).collect())


def test_triangles_against_all_paths(spark):
    """A hub that all follow and that follows all, and random links."""
    rng = random.Random(3)
    pairs = {(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(400)} | {("hub", f"n{i}") for i in range(41)} | {(f"n{i}", "hub") for i in range(0, 41, 2)}
    pairs = {(a, b) for a, b in pairs if a != b}
    got = sorted(tuple(r) for r in graph.triangles(links(spark, sorted(pairs))).collect())
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = sorted((c, x, z) for c in out for x in out[c] for z in out.get(x, ()) if z in out[c] and z != c)
    assert got == want and len(want) > 1000


def test_a_hub_starts_no_pairs(spark):
    """In a wheel every triangle starts at the rim: the hub has the most edges, so
    that it leads nowhere."""
    wheel = [("hub", f"n{i}") for i in range(3000)] + [(f"n{i}", f"n{i + 1}") for i in range(2999)]
    assert graph.triangles(links(spark, wheel)).count() == 2999
    led = graph.directed(links(spark, wheel))
    assert led.where("l.u = 'hub'").count() == 0 and led.groupBy("l").count().agg({"count": "max"}).first()[0] <= 3


def test_clusters(spark):
    scores = spark.createDataFrame([(0, f"u{i}", float(s)) for i, s in enumerate([1, 3, 4, 2, 5, 6, 7, 7])], "cluster_id int, user_name string, pr double")
    assert [(r.place, r.user_name) for r in cluster.top_users(scores, 3).orderBy("place").collect()] == [(1, "u6"), (2, "u7"), (3, "u5")]
    assigned = spark.createDataFrame([(0, [1.0, -2.0]), (0, [3.0, -4.0])], "cluster_id int, features array<double>")
    assert sorted(map(tuple, cluster.feature_stats(assigned).collect())) == [(0, 1, 2, 1.0, 3.0, 2.0, 1.0), (0, 2, 2, -4.0, -2.0, -3.0, 1.0)]


def test_shaping(spark):
    posts = spark.createDataFrame([(2, "u", "b"), (1, "u", "a"), (1, "v", "hi @U: x")], "ts long, user_name string, text string")
    assert {r.user_name: r.text for r in dataset.merge_posts(posts).collect()} == {"u": "a b ", "v": "hi @U: x "}
    assert [(r.user_name, r.ts) for r in dataset.posts_about(posts, " U ").collect()] == [("u", 1), ("u", 2), ("v", 1)]
    assert [r.text for r in dataset.numbered(posts).where("user_name = 'u'").orderBy("place").collect()] == ["a", "b"]
