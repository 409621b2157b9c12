from tickloom.llm import html as h


def test_blocks_survive_bad_markup():
    page = "<!DOCTYPE html><title>no</title><body><!-- <p>no --><p><b>one<br>two &amp;&nbsp;&eacute;<p>three<script>if (a<b) '</p>'</script> four<style>x</style></p><ul><li>a<li>b</ul><div hidden>no</div><img alt='>'>tail <a href=\"x>y\">link</a> < 5"
    assert [b.text for b in h.blocks(page)] == ["one two & é", "three four", "a", "b", "tail link < 5"]
    assert h.blocks("") == [] and [b.text for b in h.blocks("plain")] == ["plain"]
    assert h.blocks("<p") == [] and [b.text for b in h.blocks("<td>x<td>y")] == ["x", "y"]


def test_viterbi_equals_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        chain = h.Chain({f"f{i}": tuple(rng.normal(size=2)) for i in range(4)}, rng.normal(size=(2, 2)), rng.normal(size=2))
        rows = [[f"f{rng.integers(4)}"] for _ in range(6)]
        e = chain.emissions(rows)
        score = lambda s: chain.first[s[0]] + sum(e[i, x] for i, x in enumerate(s)) + sum(chain.moves[a, b] for a, b in zip(s, s[1:]))
        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert tuple(chain.decode(rows)) == best


def test_held_out_pages():
    chain = h.trained()
    right = total = 0
    for page, states in h.labelled_pages(80, seed=77):
        found = h.blocks(page)
        assert len(found) == len(states)
        right += sum(a == b for a, b in zip(chain.decode(h.features(found)), states))
        total += len(states)
    assert right / total > 0.98


def test_tables(spark):
    page = "<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><article><h1>Head</h1><p>First  text.</p><p>Second text here.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, None), (None, "v", "", "t"), (3, "w", "<article><p>" + "word " * 60000 + "</p></article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in h.extracted(pages).collect()), key=lambda r: str(r[0]))
    assert got[0][1] == got[1][1] == "Head\nFirst text.\nSecond text here."
    assert got[2][1] == "" and got[4] == (None, "", 0) and got[3][2] == 5 * 60000 - 1
    assert h.extracted(pages.limit(0)).count() == 0


def test_only_hiding_attributes_hide():
    shown = ['title="a hidden gem"', 'class="card hidden md:block"', "data-x='hidden '", 'title="display: none"', 'aria-hidden="false"', 'title="aria-hidden=true"', 'alt=x class=" hidden "', 'style="overflow: hidden ; display:block"']
    for a in shown:
        assert [b.text for b in h.blocks(f"<div {a}>text</div>")] == ["text"], a
    for a in ("hidden", "HIDDEN=''", 'class="x" hidden', 'class="x"hidden', "hidden=until-found", "style='color:red;display : none'", "style=display:none", 'aria-hidden="true"', "aria-hidden=true"):
        assert h.blocks(f"<div {a}>text</div>") == [], a


def test_text_of_math_stays():
    page = "<p>so <math display='block'><mrow><mi>x</mi><mspace/><mo>=</mo><mn>2</mn></mrow></math> holds<p>next"
    assert [b.text for b in h.blocks(page)] == ["so x=2 holds", "next"]


def test_deep_nesting_takes_linear_time():
    import time

    for unit in ("<div>x", "<b><i>x</u>", "<ul><li>x</p>", "<p><table><tr><td>x"):
        took = []
        for n in (2000, 16000):
            began = time.process_time()
            assert len("".join(b.text for b in h.blocks(unit * n)).replace(" ", "")) == n
            took.append(time.process_time() - began)
        assert took[1] < 24 * max(took[0], 0.02), unit
