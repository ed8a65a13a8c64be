"""The small labelled table of the block classifier: pages written for it, in which the text blocks of
the main text start with ``@@``. Everything else on them is around the article."""

from __future__ import annotations

_LONG = " ".join(["The river rose slowly through the night and by morning the lower meadows lay under water as far as the mill."] * 3)
_MID = "Nobody in the village could remember a spring with so much rain."
_SHORT = "They waited."
_TALK = "When the snow on the hills melts early the wells of the valley fill and boats can pass under the old bridge".split()


def _words(n: int) -> str:
    return " ".join(_TALK[k % len(_TALK)] for k in range(n))


def _unmarked(tag: str, lengths: tuple[int, ...], between: str = "", top: str = "", end: str = "") -> str:
    """A page without a name, an article or a frame: paragraphs of ``lengths`` words in ``tag``, with ``between`` after each second one."""
    story = "".join(f"<{tag}>@@{_words(n)}</{tag}>{between if k % 2 else ''}" for k, n in enumerate(lengths))
    return f"""<html><body><div><a href="/">Home</a></div><div><a href="/n">News of the day</a></div><div><a href="/w">Weather</a> | <a href="/s">Sports</a></div>
    {top}<h1>@@{_words(6)}</h1><div>{story}</div>{end}<div><a href="/a">About us</a></div><div><a href="/t">Terms of use and more</a></div></body></html>"""

BLOCK_PAGES = (
    # An article element between a menu, an advert and a footer.
    f"""<html><head><title>Rain</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li>
    <a href="/c">Sports today</a></li></ul></nav><div class="ad">Buy two umbrellas and get a third one for free this week only.</div>
    <article><h1>@@Rain in the valley</h1><p><b>@@A short lead for the reader.<br><p>@@{_LONG}</p><p>@@{_SHORT}</p><p>@@{_MID}</p>
    <p>@@All rights of way were closed.</p></article><footer>&copy; 2020 Valley Paper &middot; {_MID}</footer></body></html>""",
    f"""<html><body><nav><a href="/">Start</a></nav><div class="ad">Cheap.</div><article><h1>@@Short</h1><p>@@{_SHORT}</p></article>
    <footer>Contact us by letter at the old mill.</footer></body></html>""",
    f"""<html><body><div>Ferry times have changed for the summer, see the board at the landing.</div><article><h1>@@Long</h1><p>@@{_LONG}</p>
    <p>@@{_LONG} <a href="x">with a link to the map of the flood</a> {_SHORT}</p></article><div>{_LONG}</div><p>{_MID}</p></body></html>""",
    # Things around the text inside an article element.
    f"""<html><body><header><h2>Valley Paper</h2><p>{_MID}</p></header><main><article><header><h1>@@Bridge closed</h1></header><p>@@{_MID}</p>
    <ul class="share"><li><a href="#">Post</a></li><li><a href="#">Mail this</a></li></ul><p>@@{_LONG}</p><aside><h3>Related</h3><p>{_MID}</p></aside>
    <blockquote>@@We had to turn back.</blockquote><ul><li>@@One pump for each house</li><li>@@Sand</li></ul><div>@@{_MID}</div>
    <table><tr><td>@@Gauge</td><td>@@4 m</td></tr></table>
    <figure><figcaption>@@The bridge in May.</figcaption></figure><pre>@@low high low</pre><form><label>Your mail</label><input><p>Send {_MID}</p></form>
    <section class="comments"><h3>Comments</h3><p>{_LONG}</p><div class="comment"><p>{_SHORT}</p></div></section>
    <div class="newsletter"><p>{_MID}</p></div></article></main><aside><ul><li>{_SHORT}</li><li><a href="/">{_MID}</a></li></ul></aside>
    <div id="cookie-notice">We use cookies. {_MID}</div></body></html>""",
    # A main element or a marked div in place of an article element.
    f"""<html><body><div id="header"><div class="logo">Valley Paper</div></div><div class="sidebar"><p>{_LONG}</p><ul><li><a href="/">{_MID}</a></li></ul></div>
    <div class="post-content"><h2>@@High water</h2><p>@@{_LONG}</p><div>@@{_MID}</div><p>@@{_SHORT}</p><ol><li>@@Stay inside</li></ol>
    <p>@@See <a href="/map">the map</a></p></div><div class="banner">{_MID}</div><p>Printed on paper from the mill. {_SHORT}</p></body></html>""",
    f"""<html><body><p>Skip to the text</p><main><h1>@@Dry again</h1><p>@@{_MID}</p><p>@@{_SHORT}</p><h2>@@What now</h2><div>@@{_LONG}</div><div>@@{_SHORT}</div><div>@@<a href="/d">Dams</a></div><div>@@{_LONG}</div>
    <div class="alert">{_MID}</div></main><p>{_MID}</p><div>{_LONG}</div></body></html>""",
    f"""<html><body><div>Menu of the day</div><p>{_LONG}</p><div class="entry"><h1>@@Wells</h1><p>@@{_LONG}</p><p>@@{_SHORT}</p><p>@@{_MID}</p><div>@@{_MID}</div><ul>
    <li>@@<a href="/w">Wells of the valley</a></li><li>@@<a href="/x">Old pumps</a></li></ul><div>@@{_SHORT}</div><p>@@<a href="/y">{_MID}</a></p><div>@@{_LONG}</div><p>@@<a href="/z">{_SHORT}</a></p><p>@@{_LONG}</p></div><p>{_LONG}</p>
    <p>{_SHORT}</p><h3>{_SHORT}</h3><p>{_MID}</p><div>{_LONG}</div><ul><li>{_MID}</li></ul></body></html>""",
    f"""<html><body><p>{_MID}</p><h2>Paper</h2><article><h1>@@Wind</h1><p>@@{_SHORT}</p><p>@@<a href="/1">Wind in the hills</a></p><p>@@{_LONG}</p>
    <div>@@{_SHORT}</div><p>@@{_MID}</p></article><h3>Weather</h3><p>{_LONG}</p><div>{_LONG}</div><p>{_SHORT}</p><p>{_LONG} <a href="/">{_SHORT}</a></p></body></html>""",
    # Any block and any order of blocks inside a marked part is text, links too.
    "<html><body><div>Paper</div><main>" + "".join(
        f"<{a}>@@{x}</{a}><{b}><a href='/l'>@@{y}</a></{b}>" for a, b in (("p", "div"), ("div", "div"), ("div", "p"), ("h2", "div"))
        for x, y in ((_LONG, _MID), (_SHORT, _MID), (_MID, _SHORT), (_LONG, _SHORT))) + f"</main><p>{_LONG}</p><div>{_LONG}</div></body></html>",
    # Nothing marked: words and links decide.
    f"""<html><body><div><a href="/">Home</a> <a href="/n">News</a> <a href="/w">Weather</a></div><h1>@@The mill</h1><p>@@{_LONG}</p><p>@@{_MID}</p>
    <p>@@{_LONG} <a href="m">the mill</a></p><p>@@{_SHORT}</p><ul><li><a href="/1">More on mills</a></li><li><a href="/2">{_MID}</a></li></ul>
    <div><a href="/imprint">Imprint</a></div></body></html>""",
    f"""<html><body><table><tr><td><a href="/">Start page</a></td><td><a href="/x">About us</a></td></tr></table><h2>@@Old news</h2><div>@@{_LONG}</div>
    <div>@@{_LONG}</div><div>Valley Paper</div><div><a href="/t">Terms of use and more</a></div></body></html>""",
    f"""<html><body><p><a href="/">Home</a> | <a href="/n">All the news of the day</a></p><h1>@@Letters</h1><p>@@{_MID}</p><p>@@{_MID}</p><p>@@{_LONG}</p>
    <p class="copyright">{_MID}</p><nav>{_MID}</nav><footer><p>{_LONG}</p></footer></body></html>""",
    f"""<html><body><h1>@@One</h1><p>@@{_SHORT}</p><p>@@{_SHORT}</p><p>@@{_MID}</p><p><a href="/more">{_MID}</a></p></body></html>""",
    # Names with a part that says main, beside text that nothing marks.
    f"""<html><head><link id="main-css" rel="stylesheet"><script id="main-js">x</script></head><body><div><a href="/">Home</a> <a href="/n">News</a></div>
    <h1 class="entry-title">@@The ford</h1><div><p>@@{_LONG}</p><p>@@{_MID}</p><p>@@{_LONG}</p></div><ul><li><a href="/2">{_MID}</a></li></ul>
    <div><a href="/imprint">Imprint</a></div></body></html>""",
    f"""<html><body><div><a href="/">Start page of the paper</a></div><h1>@@The weir</h1><div><p>@@{_LONG}</p><div class="text-center"><p>@@{_SHORT}</p></div><p>@@{_LONG}</p>
    <p>@@{_MID}</p></div><div><a href="/t">Terms of use and more</a></div></body></html>""",
    # Nothing marked, in all lengths: a short block between longer ones is text, list items and sentences with links too.
    *(_unmarked(tag, lengths) for tag in ("p", "div") for lengths in ((120, 90, 60), (45, 8, 30, 4, 50), (20, 12, 25, 15, 18), (33, 3, 70, 1, 100), (9, 14, 11, 7, 16))),
    *(_unmarked(tag, (40, 25, 60, 12, 80), f"<ul><li>@@{_words(5)}</li><li>@@{_words(1)}</li><li>@@{_words(14)}</li><li>@@{_words(2)}</li></ul>") for tag in ("p", "div")),
    *(_unmarked(tag, (40, 25, 60, 30), f"<{tag}>@@See <a href='/m'>{_words(n)}</a> and <a href='/k'>{_words(n)}</a> for more of it.</{tag}>") for tag in ("p", "div") for n in (3, 6)),
    *(_unmarked(tag, (50, 18, 35), "", f"<ul>{''.join(f'<li><a href=/{n}>{_words(n)}</a></li>' for n in (1, 4, 9))}</ul>",
                f"<ul>{''.join(f'<li><a href=/{n}>{_words(n)}</a></li>' for n in (2, 12, 7))}</ul><div><a href='/o'>{_words(20)}</a></div>") for tag in ("p", "div")),
    # Nothing marked, links around the text with a few words beside them.
    *(_unmarked(tag, (30, 50, 22), "", "<div>By <a href='/au'>our own writer</a></div>", "<div>Share: <a href='/x'>by post</a> <a href='/y'>by mail</a></div>") for tag in ("p", "div")),
    # Nothing marked, a line of advert between links and title.
    *(_unmarked(tag, (28, 64, 10, 44), "", f"<div>{_words(n)}</div>") for tag in ("p", "div") for n in (3, 7, 13)),
    # Nothing around the text: its first and last blocks are text.
    *(f"<html><body><{part}><{tag}>@@{_words(a)}</{tag}><{tag}>@@{_words(b)}</{tag}><{tag}>@@{_words(c)}</{tag}></{part}></body></html>"
      for part in ("article", "main", "div") for tag in ("p", "div") for a, b, c in ((4, 30, 12), (15, 60, 90), (2, 7, 3), (25, 9, 1))),
    *(f"<html><body><h1>@@{_words(a)}</h1><p>@@{_words(b)}</p><p>@@{_words(c)}</p></body></html>" for a, b, c in ((3, 40, 18), (7, 20, 75))),
)
