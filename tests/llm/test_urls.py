import math
from collections import defaultdict

from pyspark.sql import functions as F

from stockloom.llm import urls as U
from stockloom.llm.queries import URL_RULES

CASES = [
    ("http://A.Example.COM/En/1?x#y", "a.example.com", "/En/1", "com/", "allow"),
    ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("https://www.example.com/en/9", "www.example.com", "/en/9", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/9", "notexample.com", "/en/9", "com/", "allow"),
    ("x://b.net/es/1#q", "b.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://b.com", "b.com", "", None, "allow"),
    ("http://b.com?a/b", "b.com", "", None, "allow"),
    ("http://É.org/a", "É.org", "/a", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://b.com/x\ny", "b.com", "/x\ny", "com/", "allow"),
]


def test_hosts_paths_and_rules(llm):
    pages = llm.createDataFrame([(k, c[0], "t") for k, c in enumerate(CASES)], "page_id long, url string, template string")
    rows = {r.page_id: r for r in U.judge_urls(pages, URL_RULES).collect()}
    assert len(rows) == len(CASES)
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == (host, path, rule, verdict)


def closest_first(sums, z):
    """Join the two groups that differ least, over all pairs, until every pair differs."""
    groups = [[name] for name in sums]

    def statistic(one, two):
        n, b = (sum(sums[x][k] for x in one) for k in (0, 1))
        m, c = (sum(sums[x][k] for x in two) for k in (0, 1))
        p = (b + c) / (n + m)
        return abs(b / n - c / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m)) if 0 < p < 1 else 0.0

    while len(groups) > 1:
        found, i, j = min((statistic(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if found > z:
            break
        groups[i] += groups.pop(j)
    return groups


def test_a_chain_of_small_steps_is_not_one_branch():
    counts = [(f"s{k:02}", 100, 5 * k) for k in range(21)]
    groups = U.merge_branches(counts, 5, 1.96)
    assert len(groups) >= 4 and max(map(len, groups)) <= 7
    want = closest_first({name: (n, b) for name, n, b in counts}, 1.96)
    assert sorted(map(sorted, groups)) == sorted(map(sorted, want))
    assert sorted(map(sorted, U.merge_branches([("a", 2, 0), ("b", 2, 0), ("c", 50, 50), ("d", 60, 60)], 5, 1.96))) == [["a"], ["b"], ["c", "d"]]


def test_literal_wildcards_stay_apart(llm):
    paths = ["/*/x", "/a|b/x", "/a/x", "/b/x", "/{number}/x", "/7/x", "/back\\slash/x"]
    rows = [(100 * k + j, f"http://h.org{p}") for k, p in enumerate(paths) for j in range(8)]
    found = {r.page_id: r.template for r in U.judge_urls(llm.createDataFrame(rows, "page_id long, url string"), []).collect()}
    assert len(set(found.values())) == len(paths)
    assert found[0] == "/\\*/x" and found[100] == "/a\\|b/x" and found[500] == "/{number}/x" and found[400] == "/\\{number\\}/x"


def slow_templates(paths, max_children, min_share, min_support, z):
    """The tree of one level after the other, in plain Python."""
    template = {p: "" for p in paths}
    for level in range(max((len(p[1]) for p in paths), default=0)):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for p, counts in paths.items():
            if len(p[1]) > level:
                sums = nodes[p[0], template[p]][p[1][level]]
                for k in range(3):
                    sums[k] += counts[k]
        names = {}
        for node, children in nodes.items():
            whole = sum(c[0] for c in children.values())
            branch = {s: "*" if len(children) > max_children and c[0] < min_share * whole else s for s, c in children.items()}
            sums = defaultdict(lambda: [0, 0])
            for s, c in children.items():
                sums[branch[s]][0] += c[1]
                sums[branch[s]][1] += c[2]
            groups = [[name] for name, (n, _) in sums.items() if n < min_support]
            groups += closest_first({name: tuple(c) for name, c in sums.items() if c[0] >= min_support}, z)
            merged = {name: "|".join(sorted(g)) for g in groups for name in g}
            for s in children:
                names[node, s] = merged[branch[s]]
        template = {
            p: t + "/" + names[(p[0], t), p[1][level]] if len(p[1]) > level else t for p, t in template.items()
        }
    return template


def test_templates_against_plain_python(llm):
    paths = {}
    for k in range(400):
        host = f"h{k % 3}"
        kinds = [("news", f"s{k}"), ("shop", f"item-{k % 90}", "{number}"), ("a", "x"), ("a", "y"), ("b", "x"), ()]
        segments = kinds[k * 7 % 6]
        bad = segments[:1] in (("shop",), ("b",)) or segments[:1] == ("a",) and k % 2 == 0
        old = paths.get((host, segments), (0, 0, 0))
        label = k % 4 != 1
        paths[host, segments] = (old[0] + 1, old[1] + label, old[2] + (label and bad))
    rows = [(h, list(s), *c) for (h, s), c in paths.items()]
    df = llm.createDataFrame(rows, "host string, segments array<string>, urls long, labelled long, blocked long")
    found = {(r.host, tuple(r.segments)): r.template for r in U.path_templates(df, max_children=20, min_share=0.05).collect()}
    assert found == slow_templates(paths, 20, 0.05, U.MIN_SUPPORT, U.Z)
    assert any("*" in t for t in found.values()) and any("|" in t for t in found.values())


def test_pure_templates_are_blocked(llm):
    rows = [(k, f"http://x.org/spam/{k}") for k in range(50)] + [(100 + k, f"http://x.org/good/{k}") for k in range(50)]
    rules = [("block", f"x.org/spam/{k}") for k in range(1, 4)] + [("block", f"x.org/spam/{k}0") for k in range(1, 5)]
    rules += [("block", "x.org/spam/5"), ("allow", "x.org/good/1"), ("allow", "x.org/good/2"), ("allow", "x.org/good/3")]
    found = {r.page_id: r.verdict for r in U.judge_urls(llm.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert found[0] == "block" and found[49] == "block"
    assert found[100] == "allow" and found[149] == "allow"


def test_odd_rows(llm):
    schema = "page_id long, url string, host string, segments string, verdict string"
    rows = [(None, "http://a.com/" + "x/" * 3000, "h", "s", "v"), (1, None, "h", "s", "v"), (1, None, "h", "s", "v")]
    found = U.judge_urls(llm.createDataFrame(rows, schema), URL_RULES).collect()
    assert len(found) == 3
    assert next(r for r in found if r.page_id is None).template.endswith("/**")
    assert U.judge_urls(llm.createDataFrame([], schema), URL_RULES).count() == 0
    shapes = llm.createDataFrame([("/a//2020-01/77.html/deadbeef12/",)], "p string")
    assert shapes.select(U.shaped_segments(F.col("p"))).first()[0] == ["a", "{date}", "{number}.html", "{hex}"]
