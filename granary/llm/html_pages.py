"""Labelled pages for the extraction model: layouts drawn at random, in which the writer knows what is main text."""

from __future__ import annotations

import random

MARK = "⁣"  # invisible separator: stands before each main block's text while a page is drawn

_SYLLABLES = "ka lo mi re tu sen dor vel ast ing ur ble qua ni fo sha the and of".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        # odd text is no sign of boilerplate: capitals, symbols and bars occur in articles as well
        text = self.words(1, 18)
        text = self.r.choice([text.capitalize() + ".", text.capitalize() + self.r.choice(".!?"), text.upper() + "!!", text.replace(" ", " | "), text.replace(" ", "*** "), text])
        return text

    def prose(self, a: int = 1, b: int = 6) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(a, b)))
        if self.r.random() < 0.2:
            k = self.r.choice(["b", "i", "em", "a href='#'", "span class='x'", "code"])
            cut = text.find(" ", len(text) // 2)
            if cut > 0:
                text = f"{text[:cut]} <{k}>{self.word()}</{k.split()[0]}>{text[cut:]}"
        return text.replace("ing ", "ing &amp; ", 1) if self.r.random() < 0.2 else text

    def name(self, *names: str) -> str:
        return self.r.choice([f' class="{self.r.choice(names)}"', f' id="{self.r.choice(names)}"', f' class="{self.r.choice(names)} box"'])

    def links(self, tag: str = "ul") -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(2, 8))]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def junk(self) -> str:
        r = self.r
        return r.choice([
            lambda: f"<nav{r.choice(['', self.name('menu', 'nav', 'breadcrumbs')])}>{self.links(r.choice(['ul', 'a']))}</nav>",
            lambda: f"<div{self.name('menu', 'navbar', 'breadcrumb', 'pagination')}>{self.links(r.choice(['ul', 'a']))}</div>",
            lambda: f"<header{r.choice(['', self.name('site-header', 'masthead')])}><a href='/'>{self.words(1, 3)}</a> <p>{self.words(2, 9)}</p></header>",
            lambda: f"<div{self.name('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo')}>{self.prose(1, 3)}</div>",
            lambda: f"<aside{r.choice(['', self.name('sidebar', 'related')])}><h3>{self.words(1, 3)}</h3>{r.choice([self.links(), '<p>' + self.prose(1, 3) + '</p>'])}</aside>",
            lambda: f"<div{self.name('sidebar', 'related-posts', 'widget', 'share')}><h4>{self.words(1, 3)}</h4>{r.choice([self.links(), '<p>' + self.prose(1, 3) + '</p>'])}</div>",
            lambda: f"<div{self.name('cookie-banner', 'consent', 'notice', 'newsletter', 'popup')}><p>{self.prose(1, 3)}</p><button>{self.words(1, 2)}</button></div>",
            lambda: f"<form{r.choice(['', self.name('search', 'login', 'contact-form')])}><label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 2)}</button></form>",
            lambda: f"<section{self.name('comments', 'discussion', 'replies', 'comments-area')}><h3>{self.words(1, 2)}</h3>" + "".join(f"<{k}{self.name('comment', 'reply')}><p>{self.prose(1, 4)}</p></{k}>" for k in [r.choice(["div", "li", "article"])] * r.randint(1, 4)) + "</section>",
            lambda: f"<section{self.name('related-posts', 'recommended', 'more-stories related')}><h3>{self.words(1, 3)}</h3>" + "".join(f"<article{self.theme('article')}><h4><a href='/x'>{self.words(2, 6)}</a></h4><p>{self.prose(1, 2)}</p></article>" for _ in range(r.randint(1, 3))) + "</section>",
            lambda: f"<dialog open><p>{self.prose(1, 2)}</p></dialog>",
            lambda: f"<div style='display:none'>{self.prose(1, 2)}</div>",
        ])()

    def foot(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.example.com &middot; {self.prose(1, 3)}", f"<p>Copyright {self.words(1, 3)}</p>{self.links('a')}", self.prose(1, 3)])
        return self.r.choice([f"<footer>{inner}</footer>", f"<div{self.name('footer', 'site-footer', 'copyright')}>{inner}</div>"])

    def theme(self, kind: str) -> str:
        """Names such as themes give to html, body, wrappers and articles; they say nothing of the text within."""
        r = self.r
        states = ["has-sidebar", "no-sidebar", "has-header-image", "comments-open", "has-post-thumbnail", f"category-{self.word()}", f"tag-{self.word()}", "page-template-default", "logged-in", "nav-closed", "with-menu", "sidebar-right", "js-nav-ready", f"postid-{r.randint(1, 99)}", "cookie-bar-visible", "search-enabled", "is-sponsored"]
        own = {"body": ["page", "single", "home", "blog", self.word()], "article": ["post", f"post-{r.randint(1, 99)}", "hentry", "entry", "review", "story", self.word()], "div": ["site", "wrapper", "content-sidebar-wrap", "site-container", "content-area", "layout", self.word()]}[kind]
        if r.random() < 0.35:
            return ""
        names = r.sample(own, r.randint(0, 2)) + r.sample(states, r.randint(0, 4))
        r.shuffle(names)
        return f' class="{" ".join(names)}"' if names else ""

    def main(self) -> str:
        """The article's inside; MARK begins each block of it."""
        r, out = self.r, []
        if r.random() < 0.85:
            k = r.choice(["h1", "h1", "h2"])
            out.append(f"<{k}>{MARK}{self.words(1, 12)}</{k}>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            out.append(r.choices([
                f"<p>{MARK}{self.prose()}</p>",
                f"<p><b>{MARK}{self.prose()}<br>",
                f"<p>{MARK}{self.prose()}",
                f"<div>{MARK}{self.prose()}</div>",
                f"<h2>{MARK}{self.words(1, 8)}</h2>",
                "<ul>" + "".join(f"<li>{MARK}{self.prose(1, 2)}</li>" for _ in range(r.randint(1, 4))) + "</ul>",
                f"<blockquote><p>{MARK}{self.prose(1, 3)}</p></blockquote>",
                f"<pre>{MARK}{self.prose(1, 3)}</pre>",
                "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>",
                f"<p>{MARK}{self.prose(1, 2)}<br>{MARK}{self.prose(1, 2)}</p>",
                f"<figure><img src='x.png'><figcaption>{MARK}{self.words(2, 9)}</figcaption></figure>",
                f"{self.junk()}" if r.random() < 0.5 else f"<p>{MARK}{self.prose()}</p>",
            ], [6, 3, 2, 2, 2, 1, 1, 0.5, 0.7, 1.5, 0.7, 1.2])[0])
        return "".join(out)

    def page(self) -> str:
        r = self.r
        shell = r.choices(["<article{}>", "<main{}>", "<div{}>", "<main><article{}>", "<section{}>"], [6, 2, 3, 2, 1])[0]
        name = r.choice(["", "", self.name("content", "post", "entry-content", "article-body", "story", "main")]) if "div" not in shell and "section" not in shell else self.name("content", "post", "entry-content", "article-body", "story", "main-text")
        if "article" in shell or "main" in shell:
            name = r.choice([name, self.theme("article"), self.theme("article")])
        ends = "".join(f"</{t}>" for t in (("article", "main") if "><" in shell else (shell[1:].split("{")[0],)))
        before = "".join(self.junk() for _ in range(r.choice([0, 1, 1, 2, 3])))
        after = "".join(self.junk() for _ in range(r.choice([0, 0, 1, 2, 3])))
        foot = self.foot() if r.random() < 0.8 else ""
        head = f"<head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        if r.random() < 0.3:
            shell, ends = f"<div{self.theme('div')}>{shell}", f"{ends}</div>"
        body, site = self.theme("body"), (f"<div{self.theme('div')}>", "</div>") if r.random() < 0.4 else ("", "")
        return f"<!DOCTYPE html><html lang='en'>{head}<body{body}>{site[0]}{before}{shell.format(name)}{self.main()}{ends}{after}{foot}{site[1]}</body></html>"


def labelled(n: int, seed: int = 1) -> list[tuple[list, list[int]]]:
    """n pages as blocks and labels."""
    from granary.llm.html import blocks

    out = []
    for k in range(n):
        found = blocks(_Writer(seed * 1_000_003 + k).page())
        labels = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "").strip() or "."
        out.append((found, labels))
    return out
