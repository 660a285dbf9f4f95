"""Page, URL, licence and vector operators against brute force on small tables."""
import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoria.llm import extract, licences, neighbours, urlfilter
from memoria.llm.queries import SEARCH_FACTOR, URL_RULES, document_number

from .data import frame

PAGES = "page_id long, url string, html string"
ART = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
       "<header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
       "<div class='ad'>Buy now.</div><article><h1>%s</h1><p><b>First   one &amp; two.<br><p>Second\n part %s."
       "<div><a href='/s'>Share this</a></div></article><aside>Side</aside><section class='comments'>"
       "<article><p>A reader says.</p></article></section><form>Mail <input></form><footer>&copy; x</footer></body>")
PLAIN = "<html><body><div>Welcome to our site</div><p>%s</p><p>Contact us today</p></body></html>"


def pages(spark, rows):
    df = spark.createDataFrame(rows, PAGES)
    return df.repartition(3) if rows else df


def test_main_text(spark):
    rows = [(i, f"http://a.example/en/{i}", ART % (f"Title {i}", i)) for i in range(5)]
    rows += [(10 + i, f"http://b.example/x/{i}", PLAIN % f"Own words of page {i}") for i in range(5)]
    rows += [(20, None, None), (21, "http://c.example/", ""), (22, "nonsense", "<p>alone"),
             (23, "http://c.example/1", "<article><p>" + "long " * 50_000 + "</p></article>"),
             (None, "http://d.example/", PLAIN % "only one"), (22, "nonsense", "<p>alone")]
    # copies of one article on a host stay whole
    rows += [(30 + i, f"http://e.example/{i}", PLAIN % "the same article") for i in range(3)]
    got = {(r["page_id"], r["url"]): r for r in extract.main_text(pages(spark, rows).withColumn(
        "text", F.lit("clash")), block_pages=2).collect()}
    for i in range(5):
        assert got[i, f"http://a.example/en/{i}"]["text"] == f"Title {i} First one & two. Second part {i}."
        assert got[10 + i, f"http://b.example/x/{i}"]["text"] == f"Own words of page {i}"
        assert got[10 + i, f"http://b.example/x/{i}"]["n_shared"] == 2
    assert got[20, None]["text"] == "" and got[21, "http://c.example/"]["text"] == ""
    assert got[22, "nonsense"]["text"] == "alone"
    assert got[23, "http://c.example/1"]["n_chars"] == 5 * 50_000 - 1
    assert got[None, "http://d.example/"]["text"] == "Welcome to our site only one Contact us today"
    assert got[30, "http://e.example/0"]["text"] == "Welcome to our site the same article Contact us today"
    assert extract.main_text(pages(spark, rows)).count() == len(rows)
    assert extract.main_text(pages(spark, [])).count() == 0


def test_template_outweighs_unmarked_text(spark):
    def page(i, n):
        own = [f"Paragraph {k} of page {i}, " + " ".join(f"w{i}x{j}" for j in range(40)) for k in range(n)]
        lines = [f"Template line {k}" for k in range(30)] + own + [f"Template end {k}" for k in range(30)]
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>", " ".join(own)

    rows = [(i, f"http://a.example/{i}", page(i, 5)) for i in range(6)]
    # pages with few words of their own, and a host of two pages
    rows += [(10 + i, f"http://b.example/{i}", (page(0, 0)[0].replace("</body>", f"<p>Own {i}"), f"Own {i}"))
             for i in range(6)]
    rows += [(20 + i, f"http://c.example/{i}", page(i, 5)) for i in range(2)]
    # copies that differ in a line stay whole on a host of other pages
    copy = [page(50, 8)[0].replace("Paragraph 0", f"Paragraph {i}") for i in (0, 9)]
    rows += [(30 + i, f"http://d.example/y/{i}", page(30 + i, 5)) for i in range(5)]
    rows += [(40 + i, f"http://d.example/x/{i}", (c, None)) for i, c in enumerate(copy)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(
        pages(spark, [(i, u, h) for i, u, (h, _) in rows]), block_pages=4).collect()}
    for i, _, (_, own) in rows:
        if own is not None:
            assert got[i] == own, i
    for i in (40, 41):
        assert all(f"Paragraph {k} of page 50" in got[i] for k in range(1, 8))


def test_template_inside_article(spark):
    art = ("<body><nav>Menu</nav><article><h1>Title %s</h1><p>Sign up for our letter</p><p>Own words %s</p><p>%s</p>"
           "<p>Find us here</p><p>All about us</p><p>Help</p></article></body>")
    # pairs of pages quote one passage
    rows = [(i, f"http://a.example/{i:02}", art % (i, i, f"Quoted by some {i // 2 * 2}")) for i in range(12)]
    # the pages of a host that hold one article in equal copies keep it
    rows += [(20 + i, f"http://b.example/{i:02}", art % (0, 0, "same")) for i in range(12)]
    got = {r["page_id"]: r for r in extract.main_text(pages(spark, rows), block_pages=5).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title {i} Own words {i} Quoted by some {i // 2 * 2}"
        assert got[20 + i]["text"].startswith("Title 0 Sign up for our letter Own words 0 same Find")


def test_head_without_end_tag():
    def texts(html):
        return [t for t, zone, _ in extract.page_lines(html) if zone]

    assert texts("<html><head><title>T</title><style>p{}</style><body><p>One</p>") == ["One"]
    assert texts("<html><head><title>T</title><meta charset=x><p>One<p>Two") == ["One", "Two"]
    assert texts("<head><script>var a = '<p>no</p>';</script><span>One</span>") == ["One"]
    assert texts("<head><title>T</title> \n plain words") == ["plain words"]
    assert texts("<head><noscript><p>no</p><body><p>One</p>") == ["One"]
    assert texts("<head><noscript><p>no</p></noscript><title>T</title></head><body><p>One</p>") == ["One"]


def kept_lines(html):
    return [t for t, zone, _ in extract.page_lines(html) if zone]


WHOLE = "<h1>Head</h1><p>Words of the article that make up the page</p><p>and some more of them</p>"


@pytest.mark.parametrize("html", [
    f"<body><div class='site has-sidebar'>{WHOLE}</div></body>",
    f"<body><article><div class='entry with-sidebar'>{WHOLE}</div></article></body>",
    f"<body><form id='aspnetForm'><input><main>{WHOLE}</main></form></body>",
    f"<body><form id='aspnetForm'><input>{WHOLE}</form></body>",
    f"<body><form action='/'>{WHOLE}</form></body>",
    f"<body><div class='social-security'>{WHOLE}</div></body>",
    f"<body><div class='header-image'>{WHOLE}</div></body>",
    f"<body><div id='tags-explained'>{WHOLE}</div></body>",
    f"<body><div class='ad'>Buy</div><div class='notice'>{WHOLE.replace('h1', 'h2')}</div></body>",
    f"<body><div class='comments'><h2>2 comments</h2><article><p>No</p></article></div><main class='share'>{WHOLE}</main>",
])
def test_names_and_forms_do_not_drop_the_page(html):
    assert kept_lines(html) == ["Head", "Words of the article that make up the page", "and some more of them"]


@pytest.mark.parametrize("part", [
    "<div class='sidebar'>no</div>", "<div class='post-tags'>no</div>", "<div id='commentsArea'>no</div>",
    "<section class='related-posts'><article><p>no</p></article></section>", "<div class='ad-container'>no</div>",
    "<form><input><p>no</p></form>", "<div class='cookie-consent'>no</div>", "<nav>no</nav>", "<footer>no</footer>",
    "<div class='comments'><article><p>" + "no " * 400 + "</p></article></div>", "<p hidden>no</p>",
    "<div role='navigation'>no</div>", "<script>no</script>", "<div class='newsletter-box'><p>no</p></div>",
])
def test_parts_that_are_no_article_go(part):
    assert kept_lines(f"<body>{part}<article>{WHOLE}</article></body>") == kept_lines(f"<article>{WHOLE}</article>")
    assert "no" not in " ".join(kept_lines(f"<body>{part}{WHOLE}</body>")).split()


def brute_texts(rows):
    """The whole extraction of one table in plain loops over the lines of the pages."""
    parsed = {r: extract.page_lines(r[2]) for r in set(rows)}
    hosts = collections.defaultdict(list)
    for r in parsed:
        host, path = brute_url(r[1])[:2]
        hosts[host].append((path, -2 ** 63 if r[0] is None else r[0], r))

    def zone(lines):
        return 2 if any(z == 2 for _, z, _ in lines) else 1

    out = {}
    for members in hosts.values():
        members = [m[2] for m in sorted(members, key=lambda m: m[:2])]
        contents = {tuple(t for t, z, _ in parsed[r] if z == zone(parsed[r])) for r in members}
        n = len(contents)
        common = set()
        for line in {t for c in contents for t in c}:
            k, z = sum(line in c for c in contents), extract.TEMPLATE_SURE
            share = k / n
            low = (share + z * z / 2 / n - z * (share * (1 - share) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)
            if k > 1 and low > 0.5:
                common.add(line)
        for i, r in enumerate(members):
            lines = parsed[r]
            texts = [t for t, _, _ in lines]
            marked = any(p for *_, p in lines)
            weigh = [len(t) * (t not in common) * (p if marked else z == zone(lines)) for t, z, p in lines]
            sides = [j for j in (i - 1, i + 1) if 0 <= j < len(members)]
            near = lambda j: len(common_prefix(brute_url(r[1])[1], brute_url(members[j][1])[1]))
            found = []
            for j in sorted(sides, key=lambda j: -near(j)):
                at = extract.common_lines(texts, [t for t, _, _ in parsed[members[j]]])
                if not sum(weigh[k] for k in at) > extract.COPY_SHARE * sum(weigh):
                    found = at
                    break
            gone = {k for k in found if not lines[k][2] or texts[k] in common}
            out[r] = (" ".join(t for k, (t, z, _) in enumerate(lines) if z == zone(lines) and k not in gone), len(found))
    return out


def common_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def random_page(rng, host, own):
    template = [f"{host} line {k}" for k in range(8)]
    body = [rng.choice(template) if rng.random() < 0.4 else rng.choice(own) + f" {rng.randrange(30)}"
            for _ in range(rng.randrange(12))]
    tags = ["<p>%s</p>", "<div>%s</div>", "<div class='sidebar'>%s</div>", "<li><a href='/'>%s</a></li>"]
    inner = "".join(rng.choice(tags) % t for t in body)
    return rng.choice(["<body>%s</body>", "<body><nav>M</nav><article>%s</article></body>",
                       "<body><div>site</div><main>%s</main><footer>F</footer>"]) % inner


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_extraction_equals_plain_loops(spark, seed):
    rng = random.Random(seed)
    own = [" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = []
    for h, n in enumerate((1, 2, 3, 5, 7, 14, 40)):
        for i in range(n):
            rows.append((len(rows), f"http://h{h}.example/{rng.choice('ab')}/{rng.randrange(60)}", random_page(rng, h, own)))
    rows += [rows[3], rows[3], (None, rows[5][1], rows[5][2]), (rows[9][0], None, rows[9][2]), (900, "nonsense", None)]
    want = brute_texts(rows)
    got = extract.main_text(pages(spark, rows), block_pages=4).collect()
    assert collections.Counter((r["page_id"], r["url"], r["text"], r["n_shared"]) for r in got) == collections.Counter(
        (r[0], r[1], *want[r]) for r in rows)


def test_hosts_of_any_size_lose_their_template(spark):
    """Unmarked template lines go on hosts of two pages and more, a host of one page has nothing to compare with."""
    rows, own = [], {}
    for n in range(1, 21):
        for i in range(n):
            own[len(rows)] = f"Own words {n} {i}, " + " ".join(f"w{n}x{i}x{k}" for k in range(30))
            text = "<body><div>Welcome here</div>%s<div>Write to us</div></body>" % f"<p>{own[len(rows)]}</p>"
            rows.append((len(rows), f"http://n{n}.example/{i:02}", text))
    got = extract.main_text(pages(spark, rows)).collect()
    changed = 0
    for r in got:
        plain = f"Welcome here {own[r['page_id']]} Write to us"
        alone = r["url"].startswith("http://n1.")
        assert r["text"] == (plain if alone else own[r["page_id"]])
        changed += r["text"] != plain
    assert changed == len(rows) - 1


@pytest.mark.parametrize("cells", [1 << 28, 8])
def test_common_lines_is_a_longest_common_subsequence(cells):
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(5) for _ in range(rng.randrange(14))]
        b = [rng.randrange(5) for _ in range(rng.randrange(14))]
        at = extract.common_lines(a, b, cells)
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(at) == len(set(at)) == t[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in at)


URLS = ["https://Blog.X.example.org/en/12?page=2#top", "http://a.example.org/es/3", "http://example.org/es/",
        "http://m.shop.com/de/1.html", "http://shop.com/fr/2", "http://shop.net/de/7", "no scheme", None, "://",
        "http://HOST?x=1", "http://b.example.org/en/1", "ftp://u.com", "http://x.com/de"]


def brute_url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(r), r, a) for a, r in URL_RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_url_rules_and_mined_rules(spark):
    rng = random.Random(4)
    labelled = [(f"http://s{rng.randrange(9)}.net/{d}/{i}.html", (d == "casino") if rng.random() > .05 else False)
                for i in range(600) for d in [rng.choice(["en", "casino", "news"])]]
    train = spark.createDataFrame(labelled, "url string, bad boolean")
    urls = URLS + ["http://s1.net/casino/5", "http://new.net/casino/8", "http://new.net/en/8", URLS[0]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn(
        "tokens", F.lit("clash"))
    got = {r["page_id"]: r for r in urlfilter.url_filter(df, train, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, action = brute_url(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (action or ("block" if "casino" in path else "allow")), u
    empty = spark.createDataFrame([], "url string, bad boolean")
    assert {r["verdict"] for r in urlfilter.url_filter(df, empty, []).collect()} == {"allow"}
    assert urlfilter.url_filter(df.limit(0), train, URL_RULES).count() == 0


def test_mined_rules_equal_counts(spark):
    import itertools
    rng = random.Random(5)
    data = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.random() < .3) for _ in range(300)]
    data = [(t, b or ("a" in t and "b" in t)) for t, b in data]
    got = urlfilter.mine_rules(spark.createDataFrame(data, "tokens array<string>, bad boolean"), min_support=0.02)
    want, n_bad = set(), sum(b for _, b in data)
    for k in (1, 2, 3):
        for c in itertools.combinations("abcdef", k):
            every = [b for t, b in data if set(c) <= set(t)]
            hit = sum(every)
            if hit >= 0.02 * len(data) and hit / len(every) >= max(0.8, 1.5 * n_bad / len(data)):
                want.add((c, hit))
    assert {(tuple(r["tokens"]), r["support_rows"]) for r in got.collect()} == want and want


def test_document_number_ends_the_path(spark):
    want = {"http://a.b/en/17": 17, "http://a.b/17.html?x=3": 17, "http://a.b/17/#top": 17, "http://a.b/5?p=/9": 5,
            "http://a.b/2021/05/some-title": None, "http://a.b/blog/3-tips": None, "http://a.b/": None,
            "http://a.b/en?id=4": None, "http://a.b/" + "9" * 30: None}
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: r["n"] for r in df.select("url", document_number(F.col("url")).alias("n")).collect()} == want


def test_mined_rules_of_any_length(spark):
    import itertools
    data = [(sorted("hakb" + "z" * (i % 2)), True) for i in range(60)]
    data += [(list(c), False) for c in itertools.combinations("abhk", 3) for _ in range(50)]
    data += [(["z"], False)] * 50 + [(["y", "z"], False)] * 3
    got = urlfilter.mine_rules(spark.createDataFrame(data, "tokens array<string>, bad boolean"))
    rules, n_bad = {}, 60
    for k in range(1, 6):
        for c in itertools.combinations("abhkyz", k):
            every = [b for t, b in data if set(c) <= set(t)]
            if sum(every) >= 20 and sum(every) / len(every) >= max(0.8, 1.5 * n_bad / len(data)):
                rules[c] = sum(every) / len(every)
    want = {c for c in rules if len(c) <= 3 or not any(set(d) < set(c) and rules[d] >= rules[c] for d in rules)}
    assert {tuple(r["tokens"]) for r in got.collect()} == want and tuple("abhk") in want and len(want) < len(rules)


def test_many_shared_tokens_end_soon_and_decide(spark):
    """40 query keys of 20 bad pages: one item, and a page with any of them is blocked as by the rule of that key alone."""
    keys = "&".join(f"k{i:02}=1" for i in range(40))
    train = [(f"http://h{i}.org/p{i}?{keys}", True) for i in range(20)] + [(f"http://g{i}.com/x?a=1", False) for i in range(400)]
    train += [(f"http://g{i}.com/q?part=1&whole=2", i < 30) for i in range(30)] + [("http://g1.com/q?part=3", False)] * 90
    labelled = spark.createDataFrame(train, "url string, bad boolean")
    urls = ["http://new.net/?k07=5", "http://new.net/?k07=5&k31=2&z=1", "http://new.net/?z=1", "http://new.net/?part=1",
            "http://new.net/?whole=1", "http://new.net/?" + "y" * 200_000 + "=1&k39=1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = df.unionByName(df.where("page_id = 0"))
    for c in ("items", "item", "rule", "confidence", "_salt", "row", "n_rules"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted((r["page_id"], r["verdict"]) for r in urlfilter.url_filter(df, labelled, []).collect())
    assert got == [(0, "block"), (0, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block"), (5, "block"), (6, "allow")]


def brute_rules(data, least, confidence, lift):
    """Every token set that reaches support, confidence and lift, by counting."""
    import itertools
    tokens = sorted({t for row, _ in data for t in row})
    n_bad = sum(b for _, b in data)
    out = {}
    for k in range(1, len(tokens) + 1):
        for c in itertools.combinations(tokens, k):
            every = [b for t, b in data if set(c) <= set(t)]
            if sum(every) >= least and sum(every) / len(every) >= max(confidence, lift * n_bad / len(data)):
                out[frozenset(c)] = sum(every) / len(every)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_equal_those_of_all_rules(spark, seed):
    """Tokens of one class, and rules dropped, change no verdict against every rule by plain counting."""
    rng = random.Random(seed)
    data = []
    for _ in range(160):
        row = set(rng.sample("abcd", rng.randint(0, 3)))
        row |= {"twin1", "twin2"} if "a" in row and rng.random() < .5 else set()
        data.append((sorted(row), rng.random() < (.9 if {"twin1", "b"} <= row or "c" in row else .2)))
    rules = brute_rules([r for r in data if r[0]], 5, .75, 1.1)
    frame_ = spark.createDataFrame(data, "tokens array<string>, bad boolean")
    mined, classes = urlfilter._mine(frame_, None, 5, .75, 1.1)
    asked = [sorted(rng.sample(["a", "b", "c", "d", "twin1", "twin2", "new"], rng.randint(1, 5))) for _ in range(60)]
    sets = spark.createDataFrame([(t,) for t in asked], "tokens array<string>").distinct()
    got = {tuple(r["tokens"]): r["confidence"] for r in urlfilter.match_rules(sets, mined, classes).collect()}
    want = {tuple(t): max(c for r, c in rules.items() if r <= set(t)) for t in asked if any(r <= set(t) for r in rules)}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in got) and rules


def test_mined_support_is_a_count(spark):
    data = [(["host:rare.net"], True)] * 25 + [(["host:few.net"], True)] * 6
    data += [([f"host:h{i % 700}.net"], False) for i in range(10_000)]
    got = urlfilter.mine_rules(spark.createDataFrame(data, "tokens array<string>, bad boolean"))
    assert [tuple(r) for r in got.collect()] == [(["host:rare.net"], 1.0, 25)]


def test_licences(spark):
    fill = " ".join(f"word{i}" for i in range(300))
    mit = dict(licences.TEMPLATES[-1:])["mit"]
    rows = [(1, fill + " Released under the MIT License. " + fill), (2, fill), (3, None), (4, ""), (5, "All"),
            (6, "x\nALL RIGHTS RESERVED.\n"), (7, fill + " " + mit + " " + fill),
            (8, fill + " " + mit.replace("copy", "duplicate") + " " + fill), (9, "Licensed under CC BY-NC 4.0.")]
    rows = [(d, t, "en", "s", 1) for d, t in rows] + [(9, "Licensed under CC BY-NC 4.0.", "en", "s", 1)]
    got = {(r["doc_id"], r["licence"]): r["containment"] for r in licences.find_licences(frame(spark, rows)).collect()}
    assert set(got) == {(1, "mit"), (6, "all-rights-reserved"), (7, "mit"), (8, "mit"), (9, "cc-by-nc-4.0")}
    assert got[7, "mit"] == 1 and 0.8 <= got[8, "mit"] < 1
    assert licences.find_licences(frame(spark, [])).count() == 0


def test_licence_variants(spark):
    head = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s"
    tail = " as published by the Free Software Foundation, either version 3 of the License"
    cases = {"Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0", "Licensed under CC BY-ND 3.0.": "cc-by-nd-3.0",
             head % "Lesser General Public License" + tail: "lgpl", head % "General Public License" + tail: "gpl",
             head % "Affero General Public License" + tail: "agpl",
             "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
             "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
             "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0",
             "This is free and unencumbered software released into the public domain.": "unlicense",
             "// SPDX-License-Identifier: BSL-1.0": "bsl-1.0", "CC0 1.0 Universal": "cc0-1.0"}
    rows = [(i, f"some words before it\n{t}\nand words after it", "en", "s", 1) for i, t in enumerate(cases)]
    got = {(r["doc_id"], r["licence"]) for r in licences.find_licences(frame(spark, rows)).collect()}
    assert got == set(enumerate(cases.values()))


def vectors(n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[50]                      # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 20, [0.0] * dim), (n + 40, [float("nan")] * dim), (n + 60, [None] + [1.0] * (dim - 1)),
             (n + 80, [float("inf")] * dim), (n + 100, [1.0, 2.0]), (None, [1.0] * dim), (n + 101, [])]
    return rows


def brute_nearest(rows, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and any(v)]
    out = {}
    for q, qv in ok:
        if q % 20 == 0:
            s = [(-float(sum(a * b for a, b in zip(qv, v))), i) for i, v in ok if i != q and len(v) == len(qv)]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def found(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_nearest_exact_and_relaxed(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = {q: v for q, v in brute_nearest(rows, 20).items() if v}
    exact = found(neighbours.nearest(df, factor=1.0, shard_rows=700, block_rows=40, leaf_rows=64))
    assert {q: [i for i, _ in v] for q, v in exact.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(exact[q], want[q]))
    relaxed = found(neighbours.nearest(df, factor=SEARCH_FACTOR, shard_rows=700, block_rows=40, leaf_rows=64))
    hit = sum(len({i for i, _ in relaxed[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_repeated_ids_are_queries_of_their_own(spark):
    rows = [(i, v) for i, v in vectors(300) if v is not None and len(v) == 16]
    rows += [(0, rows[7][1]), (0, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for c in ("row", "part", "dim", "v", "ids", "score", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    got = neighbours.nearest(df, factor=1.0, shard_rows=90, block_rows=7, leaf_rows=16).collect()
    zero = collections.Counter(r["rank"] for r in got if r["query_id"] == 0)
    assert zero == {k: 3 for k in range(1, 21)} and not any(r["vec_id"] == 0 for r in got if r["query_id"] == 0)
    others = brute_nearest(rows, 20)
    for q in (20, 40):
        assert [(r["vec_id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [
            (i, round(s, 9)) for i, s in others[q]]


def test_pruning_saves_distance_work():
    """On clustered vectors the relaxed search visits fewer leaves than the exact one and finds nearly the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 4
    x = centres[rng.integers(30, size=4000)] + rng.normal(size=(4000, 16)) * 0.3
    tree = neighbours.Tree(np.arange(4000), x, 64)
    q = x[::20]
    sets = {}
    for f in (1.0, 1.5):
        qi, ids, _ = tree.search(np.arange(0, 4000, 20), q, 20, f)
        sets[f] = set(zip(qi.tolist(), ids.tolist()))
    s = q @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    true = {(i, int(j)) for i in range(200) for j in np.argsort(-s[i])[:20]}
    assert sets[1.0] == true and len(sets[1.5] & true) >= 0.9 * len(true)
