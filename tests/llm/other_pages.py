"""Pages of other shapes than those that trees are fitted on, written apart from that generator, with their main text."""

import html
import random

from tests.llm.cases import prose


def _sentences(r, a, b):
    return " ".join(prose(r.randrange(10**6), r.randint(6, 20)).capitalize() + r.choice(".!?.") for _ in range(r.randint(a, b)))


def _title(r):
    return prose(r.randrange(10**6), r.randint(3, 8)).title()


def _links(r, n, wrap):
    return "".join(wrap.format(f'<a href="/{i}/{r.randrange(999)}">{prose(r.randrange(10**6), r.randint(1, 3))}</a>') for i in range(n))


def blog(r):
    """Nested divs with ids and classes as blogs have them, comments in a list."""
    title, paragraphs = _title(r), [_sentences(r, 1, 5) for _ in range(r.randint(3, 9))]
    body = "\n".join(f"    <p>{html.escape(p)}</p>" for p in paragraphs)
    comments = "".join(f'<li class="comment depth-1" id="comment-{i}"><div class="comment-author">{_title(r)}</div><div class="comment-body"><p>{_sentences(r, 1, 3)}</p></div></li>' for i in range(r.randint(0, 6)))
    page = f"""<!doctype html>
<html><head><title>{title} | Site</title><link rel=stylesheet href=x.css><script async src=y.js></script></head>
<body class="single-post">
<div id="page">
 <div id="site-header"><a href="/" rel="home">{_title(r)}</a><span class="tagline">{_sentences(r, 1, 1)}</span></div>
 <ul id="primary-menu">{_links(r, r.randint(4, 9), "<li>{}</li>")}</ul>
 <div id="content">
  <div class="post hentry">
   <h2 class="entry-title">{title}</h2>
   <div class="entry-content">
{body}
   </div>
  </div>
  <div id="comments"><h3>{len(comments) and "Responses"}</h3><ol class="commentlist">{comments}</ol>
   <form id="commentform"><label>Say something</label><textarea name=c></textarea><button>Send</button></form></div>
 </div>
 <div id="secondary" class="widget-area"><div class="widget"><h4>Recent</h4><ul>{_links(r, 5, "<li>{}</li>")}</ul></div><div class="widget"><p>{_sentences(r, 1, 2)}</p></div></div>
 <div id="site-footer">{_title(r)} 2021. <a href="/privacy">Privacy</a></div>
</div>
</body></html>"""
    return page, " ".join([title, *paragraphs])


def manual(r):
    """Roles instead of classes; code, definitions, a table."""
    title, parts, out = _title(r), [], []
    for _ in range(r.randint(2, 5)):
        head, text = _title(r), _sentences(r, 1, 4)
        parts.append(f"<h2>{head}</h2><p>{text}</p>")
        out += [head, text]
        kind = r.random()
        if kind < 0.3:
            code = f"run({r.randrange(99)})"
            parts.append(f"<pre><code>{code}</code></pre>")
            out.append(code)
        elif kind < 0.6:
            rows = [(prose(r.randrange(10**6), 1), _sentences(r, 1, 1)) for _ in range(3)]
            parts.append("<dl>" + "".join(f"<dt>{a}<dd>{b}" for a, b in rows) + "</dl>")
            out += [x for row in rows for x in row]
        elif kind < 0.8:
            cells = [[prose(r.randrange(10**6), 2) for _ in range(3)] for _ in range(3)]
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
            out += [c for row in cells for c in row]
    page = f"""<html lang=en><head><meta charset=utf-8><title>{title}</title></head><body>
<div role="banner"><a href=/>{_title(r)}</a></div><div role="navigation"><ul>{_links(r, r.randint(5, 14), "<li>{}")}</ul></div>
<main role="main"><h1>{title}</h1>{"".join(parts)}</main>
<div role="complementary"><p>{_links(r, 4, "{} ")}</p></div><div role="contentinfo"><p>Built with care. {_links(r, 2, "{} ")}</p></div></body></html>"""
    return page, " ".join([title, *out])


def tables(r):
    """A layout of tables without a class or id, tags in capitals, paragraphs left open."""
    title, paragraphs = _title(r), [_sentences(r, 2, 6) for _ in range(r.randint(3, 8))]
    page = f"""<HTML><HEAD><TITLE>{title}</TITLE></HEAD><BODY BGCOLOR=white>
<TABLE WIDTH=800 BORDER=0><TR><TD COLSPAN=2><A HREF="/"><IMG SRC=logo.gif ALT=home></A></TD></TR>
<TR><TD WIDTH=150 VALIGN=top>{_links(r, r.randint(5, 10), "{}<BR>")}</TD>
<TD VALIGN=top><H1>{title}</H1>{"".join(f"<P>{p}" for p in paragraphs)}</TD></TR>
<TR><TD COLSPAN=2><FONT SIZE=1>&copy; 1999 <A HREF=/legal>{_title(r)}</A></FONT></TD></TR></TABLE></BODY></HTML>"""
    return page, " ".join([title, *paragraphs])


def news(r):
    """A semantic page with adverts, a related box and a share bar between paragraphs, a cookie banner on top."""
    title, paragraphs = _title(r), [_sentences(r, 1, 4) for _ in range(r.randint(4, 10))]
    between = [
        f'<div class="ad-container"><span>Advertisement</span><p>{_sentences(r, 1, 1)}</p></div>', f'<aside class="related-articles"><h3>Read more</h3><ul>{_links(r, 3, "<li>{}</li>")}</ul></aside>',
        f'<div class="social-share">{_links(r, 3, "{} ")}</div>', f'<div class="newsletter-signup"><p>{_sentences(r, 1, 1)}</p><form><input type=email><button>Join</button></form></div>', "<script>track('a < b')</script>",
    ]
    body = "".join(f"<p>{p}</p>" + (r.choice(between) if r.random() < 0.3 else "") for p in paragraphs)
    page = f"""<!DOCTYPE html><html><head><title>{title}</title><style>.a > .b {{ color: red }}</style></head><body>
<div class="cookie-banner" role="dialog"><p>{_sentences(r, 1, 2)}</p><button>OK</button></div>
<header class="top"><nav aria-label="main">{_links(r, 6, "{}")}</nav></header>
<section class="layout"><article class="story"><h1>{title}</h1>{body}</article>
<aside class="most-read"><h2>Popular</h2><ol>{_links(r, 5, "<li>{}</li>")}</ol></aside></section>
<footer><p>{_sentences(r, 1, 2)}</p>{_links(r, 4, "{} ")}</footer></body></html>"""
    return page, " ".join([title, *paragraphs])


def bare(r):
    """Text that no element holds."""
    paragraphs = [_sentences(r, 1, 4) for _ in range(r.randint(1, 6))]
    return r.choice(["\n\n", "<br><br>", "<hr>"]).join(paragraphs), " ".join(paragraphs)


SHAPES = (blog, manual, tables, news, bare)


def made(n, seed=11):
    """(shape, page, main text) of n pages of each shape."""
    r = random.Random(seed)
    return [(f.__name__, *f(r)) for f in SHAPES for _ in range(n)]
