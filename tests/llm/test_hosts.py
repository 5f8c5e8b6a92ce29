import math
from collections import Counter

from pyspark.sql import functions as F

from scenefold.llm import hosts

PAGES = [
    (1, "http://Theand.Example.ORG/es/1", "<p>the and with the spam</p>"), (2, "https://m.example.org/en/12", "the and"), (3, "http://example.org/en/2", None),
    (4, "http://notexample.org/es/", ""), (5, "http://a.com/fr/x?y", "spam farm farm"), (6, "http://a.com/de/x#z", "<a href='x'>spam</a>"), (7, "http://a.com", "the"),
    (8, "http://spamfarm.net/de/9", "x"), (9, "http://andwith.net/fr/9", "x"), (10, None, "x"), (11, "no scheme", "x"), (12, "http://", "x"), (13, "ftp://b.org?q=/es/", "x"),
    (14, "http://x.org:80/a", "x"), (1, "http://a.com/fr/x?y", "again"), (None, "http://c.net/é://d.org/", "x"), (15, "http://" + "the" * 300 + ".net/de/", "x"), (16, "x\n://q.org/\nfr", "x"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule_of(host, path):
    fits = [(len(h + p), h + p, said) for said, h, p in hosts.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_verdicts(spark, pages):
    urls = pages.selectExpr("coalesce(url, '') as url").distinct().select("url", hosts.host_of(F.col("url")).alias("host"), hosts.path_of(F.col("url")).alias("path"))
    tokens = {}
    for r in hosts.url_tokens(urls, hosts.word_counts(pages.selectExpr("html as text"))).collect():
        tokens.setdefault(r.url, []).append(r.token)
    labels = {r.url: rule_of(r.host, r.path)[1] for r in urls.collect()}
    count = {v: Counter(t for u, said in labels.items() if said == v for t in tokens.get(u, [])) for v in ("block", "allow")}
    known = set(count["block"]) | set(count["allow"])
    rows = Counter(labels.values())

    def weigh(v, t):
        return math.log((count[v][t] + 1) / (sum(count[v].values()) + len(known) + 1))

    out = {}
    for url in labels:
        if labels[url] is None and "net" in parts(url)[0]:
            total = math.log((rows["block"] + 1) / (rows["allow"] + 1)) + sum(weigh("block", t) - weigh("allow", t) for t in tokens.get(url, []) if t in known)
            out[url] = "block" if total > 0 else "allow"
    return out


def test_hosts_paths_and_rules_equal_plain_python(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as word", "1 as n", "'y' as token")
    got = hosts.judge(pages).collect()
    assert len(got) == len(PAGES)
    expected = Counter()
    for page, url, _ in PAGES:
        host, path = parts(url)
        expected[(page, host, path, rule_of(host, path)[0])] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == expected
    for r in got:
        assert r.verdict == (rule_of(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block")
    expected_verdicts = brute_verdicts(spark, pages)
    where = {(parts(u)[0], parts(u)[1]): v for u, v in expected_verdicts.items()}
    judged = [(r.host, r.path, r.verdict) for r in got if r.rule is None and "net" in r.host]
    assert len(judged) == 4 and all(where[host, path] == verdict for host, path, verdict in judged)
    assert hosts.judge(pages.limit(0)).count() == 0


def test_names_are_split_into_their_likeliest_words(spark):
    counts = {"the": 50, "and": 30, "then": 5, "with": 10, "spam": 4, "farm": 3, "hand": 2, "a": 20}
    total = sum(counts.values()) + 1

    def best(word):
        table = [(0.0, [])]
        for e in range(1, len(word) + 1):
            options = []
            for b in range(max(0, e - hosts.LONGEST), e):
                piece = word[b:e]
                if piece in counts:
                    options.append((table[b][0] + math.log(counts[piece] / total), [*table[b][1], piece]))
                elif e - b == 1:
                    options.append((table[b][0] + math.log(0.1 / total), [*table[b][1], piece]))
            table.append(max(options, key=lambda o: o[0]))
        return table[-1]

    names = ["theandwith", "spamfarm", "thenandhand", "xq", "a", "thespamqfarm"]
    frame = spark.createDataFrame([(n,) for n in names], "word string")
    got = {r.word: list(r.words) for r in hosts.segmented(frame, spark.createDataFrame(list(counts.items()), "piece string, n long")).collect()}
    assert got == {n: best(n)[1] for n in names}
