"""Labelled page fragments that the extraction tree is grown from.

A fragment is markup in which {+12} stands for twelve words of main text and {-12} for twelve words that are none;
[+3] and [-3] are the same inside a link. Features are measured on the blocks of the expanded page by the code that
reads real pages; a block's label is read off its words, which are no feature.
"""

from __future__ import annotations

import re

FRAGMENTS = (
    # An article with the usual frame around it.
    "<nav><ul><li>[-1]<li>[-2]<li>[-1]<li>[-3]</ul></nav><div class=ad>{-9}</div><article><h1>{+8}</h1><p>{+30}<p>{+60}<p>{+1}<p>{+45}</article><footer>{-14}</footer>",
    "<header><a href=/>{-2}</a><p>{-5}</p></header><main><h1>{+6}</h1><p>{+3}<p>{+2}<p>{+80}<ul><li>{+4}<li>{+7}<li>{+3}</ul><p>{+25}[+3]{+10}</main><footer><p>{-30}<p>[-2]</footer>",
    "<article><h2>[+6]</h2><p>{+1}</article><div class='banner top'>{-40}</div>",
    "<div class=advert><p>{-25}</p></div><article><h1>{+2}</h1><p>{+18}<div class='ad-slot'>{-25}</div><p>{+22}<aside>{-35}</aside><p>{+6}<blockquote>{+14}</blockquote><p>{+50}</article>",
    "<article><h1>{+7}</h1><p>{+4}</article><section class=comments><p>{-40}<p>{-12}<p>{-3}<p>{-70}</section>",
    "<main><article><header><h1>{+9}</h1><p>{-4}<p>[-2]</header><p>{+55}<p>{+20}<footer>{-8}[-2]</footer></article></main>",
    "<article><header><h1>{+5}</h1><p>{+32}</p></header><p>{+40}<p>{+41}</article><div id=sidebar><h3>{-2}</h3><p>{-35}<ul><li>[-5]<li>[-6]</ul></div>",
    "<article><h1>{+5}</h1><div class=legal><p>{+28}<p>{+33}</div><p>{+12}<div class=legal><p>{+26}</div></article>",
    "<article><p>{+40}<form><label>{-1}</label><p>{-6}</form><p>{+35}<form><p>{-4}</form></article><form><p>{-3}<p>{-12}</form>",
    "<article><p>{+30}<p>[-6]<p>{+45}<p>[-4]<p>{+20}[+4]{+11}<p>{+9}[+3]<ul><li>[-5]<li>[-4]<li>[-6]</ul></article>",
    "<article class='post tag-news'><p>{+9}<p>{+2}</article>", "<article><p>{+30}<div class=share><p>[-1]<p>[-1]<p>{-3}</div><p>{+45}<div class=tags>{-1}[-1][-2]</div></article><div class=share>{-3}</div>",
    "<div class=cookie-notice><p>{-25}</p></div><div class=content><h1>{+4}</h1><p>{+20}<p>{+70}<p>{+3}</div><div class=related><p>[-7]<p>[-9]<p>{-20}</div>",
    "<div class=post><h2>{+5}</h2><p>{+55}<p>{+2}</div><div class=newsletter><p>{-14}<p>{-4}</div><div id=footer><p>{-45}</div>",
    # Pages that name nothing: only a block's own and its neighbours' words and links tell.
    "<div>[-1]</div><div>[-2]</div><div>[-1]</div><h1>{+7}</h1><div>{+40}</div><div>{+4}</div><div>{+50}</div><div>{+30}</div><div>{+5}</div><div>{+60}</div><div>[-2]</div><div>[-2]</div>",
    "<table><tr><td>[-1]<td>[-1]<td>[-2]<tr><td>{-2}<tr><td>[-3]<tr><td>{+45}<tr><td>{+3}<tr><td>{+38}<tr><td>{+60}<tr><td>{-4}<tr><td>[-2]<tr><td>[-1]</table>",
    "<p>[-2]<p>{-3}<p>[-4]<p>{-2}<p>[-3]<h2>{+5}</h2><p>{+35}<p>{+1}<p>{+42}<p>{+2}<p>{+28}<p>{-5}<p>[-3]<p>{-6}<p>[-2]",
    "<div>{-3}</div><div>[-4]</div><div>{-1}</div><div>{+70}</div><div>{+12}</div><div>{+90}</div><div>{+12}[+2]{+8}</div><div>{+55}</div><div>{-4}</div><div>[-2]</div><div>{-4}</div>",
    "<h1>{+6}</h1><p>{+26}<p>{+33}<h2>{+3}</h2><p>{+48}<p>{+5}<p>{+31}<div>[-5]</div><div>[-8]</div><div>[-6]</div><div>{-2}</div>",
    "<p>{+100}<p>{+11}<p>{+100}<p>{+7}<p>{+16}<p>{+19}",
    "<p>{+25}", "<p>{+60}<p>{+40}", "<h1>{+5}</h1><p>{+34}", "<div>[-3]</div><div>{-3}</div>", "<p>{-4}", "<p>[-2]<p>{-2}<p>[-9]", "<div>{-6}[-9]{-2}</div><div>[-3][-4]</div>",
    "<div>[-1]</div><div>{-7}</div><div>[-2]</div><div>{-3}</div><div>[-1]</div>",
    "<div>[-3]</div><div>{+26}</div><div>{+8}</div><div>{+30}</div><div>[-2]</div><div>{-6}</div>",
    # Lists of links with many words: what stands between them is no text, what stands before or after them may be.
    "<div>[-14]</div><div>{-4}</div><div>[-18]</div><div>{-6}</div><div>[-15]</div><div>{-8}</div><div>[-22]</div>",
    "<div>[-16]</div><div>{-5}</div><div>[-40]</div><div>{-9}</div><div>[-30]</div><div>{+60}</div><div>{+5}</div><div>[-19]</div><div>{-3}</div><div>[-25]</div>",
    "<h2>{+4}</h2><p>{+60}<p>{+4}<p>[-20]<p>{-5}<p>[-16]<p>{-7}<p>[-17]", "<p>[-20]<p>{-6}<p>[-35]<h1>{+5}</h1><p>{+45}<p>{+7}<p>{+50}<p>{+4}<p>[-28]",
    "<div>{+30}[+2]</div><div>{+6}</div><div>{+44}</div><div>{+3}</div><div>[-14]{-2}</div><div>{-3}</div><div>[-12]{-1}</div>",
    "<ul><li>[-12]{-4}<li>[-13]{-3}<li>[-11]</ul><p>{-6}<ul><li>[-14]<li>[-16]</ul><p>{+70}<p>{+8}<p>{+65}<p>{+6}<ul><li>[-13]<li>[-15]</ul><p>{-8}",
    "<p>{+22}<p>{+9}<p>{+3}<p>{+30}<p>{+2}<p>{+1}<p>{+40}", "<div>[-2]</div><div>{+18}</div><div>{+20}</div><div>{+9}</div><div>{+24}</div><div>[-4]</div><div>{-8}</div><div>[-5]</div>",
    "<main><p>{+3}<p>{+5}<p>{+2}</main>", "<article><p>{+4}</article>", "<article>{+1}</article>", "<nav>[-2]</nav><main>{+6}</main><footer>{-5}</footer>", "<article><p>{+12}</article>",
    "<ul><li>[-2]<li>[-1]</ul><article><p>{+8}</p></article><div>[-3]</div>", "<div class=entry><p>{+7}<p>{+2}</div><p>[-4]", "<div>[-5]</div><div class=story>{+5}</div><div>[-3]</div>",
    "<article><p>{+3}<p>[-6]<p>{+5}<p>[-5]<p>{+9}</article>", "<div>[-4]</div><article><h2>{+2}</h2>{+5}</article><div>[-4]</div><article><h2>{+3}</h2>{+11}</article>",
    "<div>[-14]</div><main><p>{+6}<p>{+13}<p>{+1}</main><div>[-20]</div><p>{-6}<div>[-13]</div>", "<p>[-3]<article><p>{+14}<p>{+2}</article><p>[-3]<p>{-14}<p>[-13]", "<article><h1>{+3}</h1><p>{+2}</article><footer>{-20}</footer>", "<article><ul><li>{+2}<li>{+1}<li>{+3}</ul><pre>{+9}</pre><table><tr><td>{+1}<td>{+2}</table></article>",
    "<article><p>{+30}<figure><figcaption>{+7}</figcaption></figure><p>{+4}<p>[-7]<h2>{+3}</h2><p>{+12}</article><div class=tags>{-2}</div>",
    # Frame parts without an article.
    "<div class=menu><p>{-2}<p>[-3]<p>{-20}</div><p>{+35}<p>{+3}<p>{+44}<div class=copyright>{-8}</div>",
    "<div class=header>{-3}</div><p>{+60}<p>{+22}<p>{+1}<p>{+33}<div class=legal>{-9}</div><div class=search>{-2}</div>",
)
MARK = re.compile(r"([{\[])([+-])(\d+)[}\]]")
MAIN, OTHER = "main", "other"


def expand(fragment: str) -> str:
    """The fragment as a page."""

    def words(m: re.Match) -> str:
        text = " ".join([MAIN if m[2] == "+" else OTHER] * int(m[3]))
        return f" <a href=/x>{text}</a> " if m[1] == "[" else f" {text} "

    return f"<html><body>{MARK.sub(words, fragment)}</body></html>"
