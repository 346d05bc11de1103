"""Operators on pages: the audit, the extraction and the url rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from statewright.llm import merkle, url_rules, wrapper

SCHEMA = "page_id long, url string, html string, file string, place long, tokens string, host string, page string"


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "t", "h", "p") for r in rows], SCHEMA)


def site(i, host="a.example.com", extra=""):
    return (
        i,
        f"https://{host}/en/{i}",
        f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/x'>menu {i}</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><div class=\"ad\">buy {i}</div><article><h1>Title {i}</h1><p><b>Bold {i} &amp; more<br>next<p>Second\n  para {i}</p><p>Share this story</p>{extra}</article>"
        f"<section id=comments><article><p>nice {i}</p></article></section><form>Name <input></form><footer>&copy; us</footer>",
    )


def test_template_is_dropped_and_slots_kept(spark):
    pages = page_table(spark, [site(i) for i in range(12)])
    for limit in (1 << 25, 0):
        rows = {r["page_id"]: r for r in wrapper.extract_main_text(pages, broadcast_bytes=limit).collect()}
        for i in range(12):
            assert rows[i]["text"] == f"Title {i} Bold {i} & more next Second para {i}"
            assert rows[i]["n_chars"] == len(rows[i]["text"])


def test_copies_do_not_make_a_template(spark):
    same = site(1)
    pages = page_table(spark, [(i, same[1], same[2].replace("Share this story", "Its own end")) for i in range(20)])
    assert {r["text"] for r in wrapper.extract_main_text(pages).collect()} == {"Title 1 Bold 1 & more next Second para 1 Its own end"}


def test_copies_of_pages_without_article_keep_their_text(spark):
    page = lambda i: f"<body><div>menu</div><div><h1>Title {i}</h1><p>Text {i}</p></div><div>end</div></body>"
    one = page_table(spark, [(i, "http://one/x", page(1)) for i in range(8)])
    assert {r["text"] for r in wrapper.extract_main_text(one).collect()} == {"menu Title 1 Text 1 end"}
    # Half of the host's pages are copies of one; whichever is the exemplar, every page keeps its own text alone.
    for k in range(4):
        rows = [(i, "http://h/x", page(k)) for i in range(8)] + [(i, "http://h/x", page(i)) for i in range(10, 18)]
        got = {(r["page_id"], r["text"]) for r in wrapper.extract_main_text(page_table(spark, rows)).collect()}
        assert got == {(i, f"Title {k} Text {k}") for i in range(8)} | {(i, f"Title {i} Text {i}") for i in range(10, 18)}


def test_pages_with_the_same_long_boilerplate_are_not_copies(spark):
    """Three long blocks on every page and a short story on each: the blocks are template."""
    rng = random.Random(12)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    plates = [word(60) for _ in range(3)]
    stories = [f"Story {i} tells of {word(5)} and ends." for i in range(30)]
    html = [f"<html><body><div>{plates[0]}</div><div>{plates[1]}</div><div><p>{s}</p></div><div>{plates[2]}</div></body></html>" for s in stories]
    pages = page_table(spark, [(i, f"http://plates.example.org/{i}", h) for i, h in enumerate(html)])
    assert {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages).collect()} == dict(enumerate(stories))


def test_long_blocks_keep_their_length():
    assert wrapper.digest("x" * 100_000) & wrapper.LONGEST == 100_000


def test_pages_without_article_or_markup():
    text = lambda h: wrapper.extract(h, None)
    assert text("plain &lt;b&gt; text") == "plain <b> text"
    assert text("<body><div id=sidebar>no</div><div>yes <i>in</i>line</div><aside>no</aside></body>") == "yes inline"
    assert text("") == "" and text("<!-- only") == "" and text("<p>a<p>b") == "a b"
    assert text("<ul><li><a>x</a><li><a>y</a></ul><p>z") == "z"
    assert text("<main>out<article>in</article></main><article class=comment>he said</article>") == "in"
    assert text("<main><p>only main</main><div class=comments><article>c</article></div>") == "only main"
    assert text("<p>1 < 2 and <b>3</p> > 2</p>") == "1 < 2 and 3 > 2"


def test_names_of_layout_do_not_hide_the_article():
    text = lambda h: wrapper.extract(h, None)
    for name in ("layout has-sidebar", "no-sidebar", "content-with-header", "search-result", "sidebar", "search widget"):
        for key in ("class", "id"):
            assert text(f"<div>top</div><div {key}='{name}'><div class=ad>buy</div><article><p>the whole story</p></article></div>") == "the whole story"
            assert text(f"<div {key}='{name}'><div class=ad>buy</div><p>the whole story</p></div>") == "the whole story"
    for name in ("cookie-notice", "main-nav", "comment-12", "left sidebar", "related_posts"):
        assert text(f"<div class='{name}'>this and that</div><div>the whole story of it</div>") == "the whole story of it"
    assert text("<div>story</div><div class=comments><article>a long answer to it</article></div>") == "story"


def tree_of(nested):
    labels, parents = [], []

    def add(node, up):
        labels.append(node[0])
        parents.append(up)
        me = len(labels) - 1
        for c in node[1]:
            add(c, me)

    add(nested, -1)
    return wrapper.Blocks(labels, parents)


def slow_matching(a, b):
    """Size of the greatest matching of two nested trees, by its definition."""
    if a[0] != b[0]:
        return 0

    def forests(xs, ys):
        if not xs or not ys:
            return 0
        return max(forests(xs[1:], ys), forests(xs, ys[1:]), slow_matching(xs[0], ys[0]) + forests(xs[1:], ys[1:]))

    return 1 + forests(a[1], b[1])


def random_tree(rng, depth=0):
    return [rng.choice("pdu") if depth else "r", [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3 if depth < 3 else 0))]]


def test_matching_is_the_best_there_is():
    rng = random.Random(1)
    for _ in range(200):
        a, b = random_tree(rng), random_tree(rng)
        m = wrapper.Matcher(tree_of(a), tree_of(b))
        pairs = list(m.pairs())
        assert len(pairs) == m.score(0, 0) == slow_matching(a, b)
        x, y = m.a, m.b
        assert all(x.labels[i] == y.labels[j] for i, j in pairs)
        place = dict(pairs)
        assert len(set(place.values())) == len(place) and all(place[x.parents[i]] == y.parents[j] for i, j in pairs if i)


def test_merging_keeps_every_node():
    rng = random.Random(2)
    for _ in range(100):
        trees = [tree_of(random_tree(rng)) for _ in range(4)]
        whole = wrapper.merged(trees)
        for t in trees:  # each tree's nodes are in the whole, in order and nested alike
            assert wrapper.Matcher(t, whole).score(0, 0) == len(t.labels)
        assert len(whole.labels) <= sum(len(t.labels) for t in trees)


def test_long_lists_are_matched_in_one_sweep():
    xs = ["r", [["p" if i % 3 else "d", []] for i in range(900)]]
    ys = ["r", [["u", []], *xs[1][:-1], ["u", []]]]
    pairs = list(wrapper.Matcher(tree_of(xs), tree_of(ys)).pairs())
    assert len(pairs) == 900 and len({j for _, j in pairs}) == 900


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    """The table's limit tells how a matching is found, not which one."""
    rng = random.Random(4)
    for n in (12, 60, 600):
        xs, ys = (["r", [[rng.choice("pdu"), [["s", []]] * rng.randint(0, 2)] for _ in range(n + rng.randint(0, 9))]] for _ in "ab")
        found = []
        for cells in (0, 10**9):
            monkeypatch.setattr(wrapper, "TABLE_CELLS", cells)
            m = wrapper.Matcher(tree_of(xs), tree_of(ys))
            found.append((list(m.pairs()), m.score(0, 0)))
        assert found[0] == found[1] and len(found[0][0]) == found[0][1]


def plain_site(rng, pages, pool=5):
    """Pages of div elements whose names say nothing, and the article of each: menus, adverts and footers come from small pools."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    menus, adverts, feet = ([line(n) for _ in range(pool)] for n in (3, 12, 9))
    out = []
    for i in range(pages):
        paragraphs = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 9))]
        title = line(4)
        advert = f"<div class=x7>{rng.choice(adverts)}</div>" if rng.random() < 0.7 else ""
        menu = "".join(f"<div>{rng.choice(menus)}</div>" for _ in range(rng.randint(2, 5)))
        page = f"<body><div class=x1>{menu}</div>{advert}<div class='x2 n{i}'><h2>{title}</h2>{''.join(f'<p>{p}' for p in paragraphs)}</div><div class=x3>{rng.choice(feet)}<br>{i % 3}</div></body>"
        out.append((f"http://plain.org/{i}", page, " ".join([title, *paragraphs])))
    return out


def test_the_wrapper_alone_tells_the_article(spark):
    made = plain_site(random.Random(4), 60)
    rows = [(i, url, page) for i, (url, page, _) in enumerate(made)] + [(100 + i, made[0][0], made[0][1]) for i in range(30)]
    want = {i: text for i, (_, _, text) in enumerate(made)} | {100 + i: made[0][2] for i in range(30)}
    for limit in (1 << 25, 0):
        got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(page_table(spark, rows), broadcast_bytes=limit).collect()}
        assert got == want
    # Without it nothing tells them apart.
    assert all(wrapper.extract(page, None) != text for _, page, text in made)


def test_slots_count_more_than_names(spark):
    rng = random.Random(6)
    made = plain_site(rng, 40)
    rows = [(i, url, page.replace("class='x2 ", "class='sidebar ")) for i, (url, page, _) in enumerate(made)]
    teaser = "<article><p>Read {}</p></article>"
    rows += [(100 + i, url.replace("plain", "teaser"), page.replace("<div class=x3>", teaser.format(i) + "<div class=x3>")) for i, (url, page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(page_table(spark, rows)).collect()}
    assert all(got[i] == text for i, (_, _, text) in enumerate(made))
    assert all(got[100 + i].startswith(text) for i, (_, _, text) in enumerate(made))


def test_attributes_are_read_whole():
    text = lambda h: wrapper.extract(h, None)
    assert text('<article style="overflow:hidden">whole</article>') == "whole"
    assert text('<p title="a hidden gem" data-class="sidebar">whole</p>') == "whole"
    assert text("<p data-x=don't>whole</p><p>it's</p>") == "whole it's"
    assert text("<p hidden>not</p><p aria-hidden='true'>not</p><p style='display: none'>not</p><p aria-hidden=false>whole</p>") == "whole"
    assert text("<div class=\"layout has-sidebar\"><main>whole</main></div>") == "whole"
    assert text("<article><div class='article-header'><h1>Title</h1></div><p>text</article>") == "Title text"
    assert text("<div class=siteFooter>us</div><div>the whole text of it</div>") == "the whole text of it"
    assert text("<p a='x>y' b=\"<p>\" c = z>whole</p><a href=/x/>in</a>") == "whole in"


def test_deep_pages(spark):
    deep = "<div>" * 10_000 + "deep" + "</div>" * 10_000
    rows = [(i, f"http://deep/{i}", deep.replace("deep", f"deep {i}") if i % 2 else "<p>flat") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(page_table(spark, rows)).collect()}
    assert got == {i: f"deep {i}" if i % 2 else "flat" for i in range(6)}
    assert wrapper.extract("<b>" * 5000 + "x", None) == "x" and wrapper.extract("<ul><li>" * 3000 + "x", None) == "x"


def test_awkward_pages(spark):
    rows = [(1, None, None), (None, "no host", "<p>x"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "http://h/#", "<p>" + "word " * 50_000), (4, "x://", "<div" + "<div>" * 300 + "deep")]
    pages = page_table(spark, rows)
    got = wrapper.extract_main_text(pages).collect()
    assert len(got) == 6 and {r["page_id"]: r["n_chars"] for r in got}[3] == 5 * 50_000 - 1
    assert wrapper.extract_main_text(pages.limit(0)).count() == 0
    verdicts = url_rules.url_verdicts(pages).collect()
    assert len(verdicts) == 6 and all(r["verdict"] == "allow" for r in verdicts)
    assert url_rules.url_verdicts(pages.limit(0)).count() == 0
    assert merkle.audit(pages, pages).count() == 0 and merkle.audit(pages.limit(0), pages.limit(0)).count() == 0


# -- audit


def test_damage_is_located(spark):
    pages = page_table(spark, [site(i) for i in range(3000)])
    other = pages.where("page_id <> 77").withColumn("html", F.when(F.col("page_id") == 5, "gone").otherwise(F.col("html")))
    other = other.unionByName(page_table(spark, [site(9000)]))
    rows = {(r["status"], r["record_id"]): r for r in merkle.audit(pages, other).collect()}
    assert set(rows) == {("missing", 77), ("changed", 5), ("added", 9000)}
    i, url, html = site(5)
    record = f"WARC/1.1\nWARC-Type: response\n{i}\n{url}\n\n{html}\n\n"
    assert rows["changed", 5]["digest"] == hashlib.sha256(record.encode()).hexdigest()
    assert rows["added", 9000]["digest"] is None


def test_repeats_and_crowded_keys(spark):
    rows = [(None, None, f"x{i}") for i in range(200)] + [(1, "u", "same")] * 50
    pages = page_table(spark, rows)
    fewer = page_table(spark, rows[1:-1])
    found = merkle.audit(pages, fewer, crowded=20).collect()
    assert sorted((r["status"], r["record_id"]) for r in found if r["record_id"]) == [("changed", 1)]
    assert [r["status"] for r in found if r["record_id"] is None] == ["missing"]


def test_roots_are_equal_only_for_equal_collections(spark):
    pages = page_table(spark, [site(i) for i in range(100)])
    root = lambda df: merkle.tree(merkle.filed(merkle.record_rows(df), 1), 1)[-1].first()["hash"]
    assert root(pages) == root(pages.orderBy(F.desc("page_id")))
    assert root(pages) != root(pages.where("page_id <> 3"))


# -- urls


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def slow_rule(host, path):
    best = None
    for verdict, name, start in url_rules.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = name + start, verdict
    return best


URLS = ["http://WWW.Example.com/en/1?x=1", "https://example.com", "https://example.com/en", "http://x.example.com/en/2#t", "ftp://é.NET/fr/", "http://net/es/a?b://c", "no scheme", None, "http://a.org/en/", "x://?q", "://com/", "http://notexample.com/en/", "http://ÀB.com/"]


def test_hosts_paths_and_rules(spark):
    rows = url_rules.url_verdicts(page_table(spark, [(i, u, "") for i, u in enumerate(URLS)])).collect()
    for r in rows:
        host, path = slow_parts(URLS[r["page_id"]])
        rule = slow_rule(host, path)
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == (rule[0] if rule else None)
        if rule:
            assert r["verdict"] == rule[1]


def test_mined_rules_equal_counting(spark):
    baskets = [(["h:a", "p:x"], "block")] * 12 + [(["h:b", "p:x"], "allow")] * 3 + [(["h:b", "p:y"], "allow")] * 10 + [(["h:a", "p:y"], "block")] * 5
    rules = url_rules.mined_rules(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.05, 0.9).collect()
    got = {(tuple(r["tokens"]), r["verdict"]): round(r["confidence"], 6) for r in rules}
    assert got == {(("h:a",), "block"): 1.0, (("h:b",), "allow"): 1.0}


def test_tokens_that_go_together_are_mined_as_one(spark):
    many = [f"h:x{i}" for i in range(30)]  # 2^30 itemsets, were they mined one by one
    labelled = spark.createDataFrame([(["all", *many], "block")] * 20 + [(["all", "p:z"], "allow")] * 30 + [(["all", "p:z", "p:w"], "allow")] * 10, "tokens array<string>, verdict string")
    names = {r["token"]: r["name"] for r in url_rules.token_names(labelled, 0.05).collect()}
    assert names == {"all": None, "p:z": "p:z", "p:w": "p:w"} | dict.fromkeys(many, "h:x0")
    asked = spark.createDataFrame([(["h:x7"],), (["all", "q:new"],), (["p:z"],), (["h:x1", "h:x2", "p:new"],), ([],)], "tokens array<string>")
    found = {tuple(r["tokens"]): r["mined"] for r in url_rules.mined_verdicts(labelled, asked, 0.05, 0.9).collect()}
    assert found == {("h:x7",): "block", ("h:x1", "h:x2", "p:new"): "block"}


def test_verdicts_equal_mining_by_hand(spark):
    """Every combination of up to all tokens, counted; the most confident rules that fit decide, allow before block."""
    from itertools import combinations

    rng = random.Random(5)
    urls = [f"http://{rng.choice(['a.example.com', 'www.example.com', 'b.c.net', 'd.org', 'e.org'])}/{rng.choice(['en', 'es', 'fr', 'x', 'x/y'])}/{i}{rng.choice(['', '?ref=1', '?page=2&ref=3'])}" for i in range(300)]
    pages = page_table(spark, [(i, u, "") for i, u in enumerate(urls)])
    rows = {r["page_id"]: r for r in url_rules.url_verdicts(pages, support=0.02, confidence=0.9).collect()}
    tokens = {r["i"]: tuple(r["t"]) for r in pages.select(F.col("page_id").alias("i"), url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    given = {i: rule[1] for i, u in enumerate(urls) if (rule := slow_rule(*slow_parts(u)))}
    seen, per = {}, {}
    for i, verdict in given.items():
        for k in range(1, len(tokens[i]) + 1):
            for c in combinations(tokens[i], k):
                seen[c] = seen.get(c, 0) + 1
                per[c, verdict] = per.get((c, verdict), 0) + 1
    everywhere = {t for t in {t for ts in tokens.values() for t in ts} if seen.get((t,), 0) >= url_rules.EVERYWHERE * len(given)}
    rules = {k: n / seen[k[0]] for k, n in per.items() if n >= 0.02 * len(given) and n / seen[k[0]] >= 0.9 and not everywhere & set(k[0])}
    for i, ts in tokens.items():
        if i in given:
            assert rows[i]["verdict"] == given[i]
            continue
        best = {v: max((p for (c, w), p in rules.items() if w == v and set(c) <= set(ts)), default=None) for v in ("allow", "block")}
        blocked = best["block"] is not None and (best["allow"] is None or best["allow"] < best["block"])
        assert rows[i]["verdict"] == ("block" if blocked else "allow")


def test_held_out_hosts(spark):
    pages = page_table(spark, [(i, f"http://h{i % 20}.example.com/{'en' if i % 3 else 'de'}/{i}", "") for i in range(300)])
    got = {(r["given"], r["mined"]): r["n"] for r in url_rules.held_out_verdicts(pages).collect()}
    assert set(got) == {("block", "block"), ("allow", "allow")}


@pytest.mark.parametrize("limit", [50_000, -1])
def test_index_matches_whole_combinations(spark, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    rules = spark.createDataFrame([(0, ["a", "b"], "block", 0.95), (1, ["c"], "block", 0.9), (2, ["c", "d"], "allow", 1.0)], "rule_id long, tokens array<string>, verdict string, confidence double")
    sets = spark.createDataFrame([(["a", "b", "x"],), (["a"],), (["c"],), (["c", "d"],), ([],)], "tokens array<string>")
    assert sorted(tuple(r["tokens"]) for r in url_rules.matched(sets, rules).collect()) == [("a", "b", "x"), ("c",)]
