"""Labelled pages for the extraction model: layouts drawn at random, the same on every run.

Each page is built of regions whose kind is known: the article, the parts of an article that are not its
text, and what stands around it. An attribute ``y`` labels elements: ``frame`` holds the article or is
indifferent, ``text`` is the article, ``chrome`` is neither; elements without it are as their parents.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

# Words of names that pages give to their parts.
NAMES = {
    "nav": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs toc toolbar pager pagination skip",
    "header": "header masthead banner topbar headerbar logo branding",
    "footer": "footer copyright colophon imprint bottom legal",
    "aside": "sidebar sidebar aside widget widgets related recommended popular trending rail",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense billboard",
    "notice": "cookie cookies consent notice notices notification gdpr popup modal overlay dialog disclaimer paywall",
    "form": "form newsletter subscribe subscription signup login search captcha",
    "comments": "comments comment reply respond replies disqus responses discussion",
    "share": "share sharing social tags meta byline tooltip",
}
TEXT_NAMES = "article articlebody content entry main post story text body"
FRAME_NAMES = "wrap wrapper container row col inner outer site page layout grid box block group holder view app root"
#: Short texts of parts that are not the article.
SAYINGS = {
    "nav": ["home", "about us", "contact", "next page", "previous", "back to top", "archive", "all topics", "skip to content", "on this page"],
    "header": ["daily news", "welcome to our site", "the paper", "since 1923"],
    "footer": ["© 2020 all rights reserved", "&copy; site", "copyright and imprint", "privacy policy and terms of use", "powered by us"],
    "aside": ["related articles", "most read", "see also", "you may also like", "popular posts", "more from us", "trending now"],
    "ad": ["advertisement", "sponsored", "buy now", "sale ends today", "ad"],
    "notice": ["we use cookies to make this site better", "accept all cookies", "please turn off your ad blocker", "this site uses cookies. read our policy", "you have read all free articles"],
    "form": ["subscribe to our newsletter", "your email", "sign up", "search", "log in", "send"],
    "comments": ["comments", "3 comments", "leave a reply", "what do you think?", "reader comments", "reply"],
    "share": ["share this", "by the staff", "posted on may 3", "filed under news", "tweet", "print this"],
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class _Layouts:
    def __init__(self, seed: int) -> None:
        self.g = random.Random(seed)

    def chance(self, p: float) -> bool:
        return self.g.random() < p

    def pick(self, words: str | list[str]) -> str:
        return self.g.choice(words.split() if isinstance(words, str) else words)

    def word(self) -> str:
        return self.g.choice(self.vocabulary)

    def words(self, n: int) -> str:
        return " ".join(self.g.choices(self.vocabulary, k=n))

    def sentences(self, n: int) -> str:
        out = []
        for _ in range(n):
            s = self.words(self.g.randrange(4, 18))
            if self.chance(0.2):
                k = s.count(" ") // 2
                s = s.replace(" ", ", ", k) if k == 1 else s
            out.append(s.capitalize() + self.g.choice("....?!"))
        return " ".join(out)

    def prose(self) -> str:
        text = self.sentences(self.g.choice((1, 1, 2, 3, 6)))
        if self.chance(0.25):
            w = text.split(" ")
            k = self.g.randrange(len(w))
            w[k] = f"<{(t := self.pick('a b i em strong span code'))}>{w[k]}</{t}>"
            text = " ".join(w)
        if self.chance(0.08):
            t = self.pick("b i strong em span")
            text = self.pick([f"<{t}>{text}</{t}>", f"<{t}>{text}<br>", f"{text}<br>{self.words(5)}"])
        return text

    def random_name(self) -> str:
        return self.pick([self.word(), f"x{self.g.randrange(99)}", f"{self.word()}-{self.word()}", f"css-{self.word()}", f"{self.pick(FRAME_NAMES)}-{self.word()}"])

    def attributes(self, y: str, names: list[str]) -> str:
        names = [n for n in names if n]
        self.g.shuffle(names)
        out = f" y='{y}'" if y else ""
        if names and self.chance(0.25):
            out += f" id='{names.pop()}'"
        if names:
            out += f" class='{' '.join(names)}'"
        return out

    def named(self, kind: str) -> str:
        """A name that tells what a part is, alone or joined with another word."""
        w = self.pick(NAMES[kind])
        return self.pick([w, w, w, f"{self.word()}-{w}", f"{w}-{self.pick(FRAME_NAMES)}", f"{w}-{self.word()}", f"{self.pick('site main page post top left entry article content')}-{w}", f"{w}-list"])

    def links(self, n: int) -> str:
        items = [f"<a href='/{self.word()}'>{self.pick(SAYINGS['nav']) if self.chance(0.3) else self.words(self.g.randrange(1, 5))}</a>" for _ in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.chance(0.7) else self.pick([" ", " | ", "", " &middot; "]).join(items)

    def blocks(self, n: int) -> str:
        """Paragraphs as an article or a reader writes them."""
        return "".join(f"<p>{self.prose()}</p>" for _ in range(n))

    def said(self, kind: str) -> str:
        text = self.pick(SAYINGS[kind])
        text = text.capitalize() if self.chance(0.7) else text
        return self.pick([f"<p>{text}</p>", f"<h3>{text}</h3>", f"<span>{text}</span>", f"<div>{text}</div>", text, f"<h2>{text}</h2>"])

    def chrome(self, kind: str, long: bool = False) -> str:
        """A part that is not the article: by its element, by its name, by both, or by what it holds alone."""
        n = self.g.choice((1, 1, 2, 3, 5, 8))
        if kind == "comments" and self.chance(0.08):
            return f"<p y='chrome' class='no-{self.pick('comments comment replies responses')}'>{self.said('comments') if self.chance(0.5) else self.words(3)}</p>"
        if kind == "comments" and self.chance(0.15):
            return "".join(f"<article y='chrome' class='{self.pick('comment reply comment-item reader-comment')}'>{self.blocks(1)}</article>" for _ in range(n))
        inside: dict[str, Callable[[], str]] = {
            "nav": lambda: self.links(2 + n),
            "header": lambda: self.pick([f"<h1>{self.words(2)}</h1>", f"<a>{self.words(2)}</a>", f"<p>{self.words(3)}</p>"]) + (self.said("header") if self.chance(0.5) else "") + (self.links(3) if self.chance(0.4) else ""),
            "footer": lambda: self.pick([self.said("footer"), f"&copy; {self.words(2)} &middot; {self.sentences(1)}"]) + (self.links(3) if self.chance(0.5) else "") + (f"<p>{self.sentences(2)}</p>" if self.chance(0.3) else ""),
            "aside": lambda: (self.said("aside") if self.chance(0.7) else "") + self.pick([self.links(n), self.blocks(n), "".join(f"<div><a>{self.words(4)}</a><p>{self.sentences(1)}</p></div>" for _ in range(n))]),
            "ad": lambda: self.pick([self.said("ad"), self.words(self.g.randrange(2, 12)).capitalize() + ".", f"<a>{self.words(4)}</a><p>{self.sentences(1)}</p>", self.blocks(1 + n // 3), f"<p>{self.said('ad')}</p>"]),
            "notice": lambda: self.pick([self.said("notice"), f"<p>{self.sentences(2)}</p><button>OK</button>", self.blocks(n)]),
            "form": lambda: self.said("form") + f"<label>{self.words(1)}</label><input name='q'>" + ("<button>Send</button>" if self.chance(0.6) else ""),
            "comments": lambda: (self.said("comments") if self.chance(0.8) else "") + self.pick(["".join(f"<{t}><b>{self.word()}</b>{self.pick([self.prose(), self.blocks(1), self.blocks(2)])}</{t}>" for _ in range(n)) for t in ("div", "li", "article", "section")] + [self.blocks(n)]),
            "share": lambda: self.said("share") + (self.links(2) if self.chance(0.5) else ""),
        }
        body = self.blocks(n) if long else inside[kind]()
        tag = TAGS.get(kind) if self.chance(0.5) else None
        name = self.named(kind) if tag is None or self.chance(0.4) else ""
        # a list of links, a line about rights or a labelled field tells itself by what it holds
        if kind in ("nav", "footer", "form", "share") and tag is None and self.chance(0.2):
            name = self.random_name() if self.chance(0.5) else ""
        if long and self.chance(0.4):
            body = self.pick([f"<div>{body}</div>", f"<article>{body}</article>", f"<div class='{self.pick(TEXT_NAMES)}'>{body}</div>"])
        tag = tag or self.pick("div div section section ul" if kind != "share" else "div div p span ul")
        if tag in ("p", "span"):  # these hold no blocks
            body = re.sub(r"</?(?:p|div|h\d|ul|li)>", " ", body)
        if tag == "ul":
            body = f"<li>{body}</li>" if "<li>" not in body else body
        names = [name, self.random_name() if self.chance(0.2) else "", self.pick(TEXT_NAMES) if self.chance(0.05) and name else ""]
        if self.chance(0.03):
            return f"<{tag} hidden{self.attributes('chrome', [])}>{self.blocks(2)}</{tag}>"
        return f"<{tag}{self.attributes('chrome', names)}>{body}</{tag}>"

    def own_names(self) -> list[str]:
        """Names that elements of an article's text may have: none, meaningless ones, or ones that mislead."""
        r = self.g.random()
        if r < 0.55:
            return []
        if r < 0.8:
            return [self.random_name()]
        if r < 0.9:
            return [self.pick(TEXT_NAMES)]
        return [self.pick([f"{self.pick('share header menu related search tags promo banner')}-{self.word()}", f"{self.word()}-{self.word()}-{self.pick('share related search tags')}"])]

    def part(self, depth: int = 0) -> str:
        """One block of an article's text."""
        k = self.g.random()
        if k < 0.62 or depth > 2:
            anchor = f" id='{self.pick([self.word(), *(self.pick(w) for w in NAMES.values())])}'" if self.chance(0.12) else ""
            return f"<p{anchor}>{self.prose() if self.chance(0.85) else self.words(self.g.randrange(1, 5)).capitalize()}</p>"
        if k < 0.75:
            anchor = f" id='{self.word()}-{self.pick(NAMES[self.pick(list(NAMES))])}'" if self.chance(0.3) else f" id='{self.pick(self.pick(list(NAMES.values())))}'" if self.chance(0.1) else ""
            h = self.pick("h2 h2 h3 h4")
            return f"<{h}{anchor}>{self.words(self.g.randrange(1, 7)).capitalize()}</{h}>"
        if k < 0.84:
            t, n = self.pick("ul ol"), self.g.randrange(1, 7)
            return f"<{t}>{''.join(f'<li>{self.words(self.g.randrange(1, 12))}</li>' for _ in range(n))}</{t}>"
        if k < 0.88:
            return f"<blockquote>{self.pick([self.prose(), self.blocks(1)])}</blockquote>"
        if k < 0.91:
            return f"<table>{''.join(f'<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>' for _ in range(self.g.randrange(1, 5)))}</table>"
        if k < 0.93:
            return f"<pre>{self.words(9)}</pre>"
        if k < 0.95:
            return f"<figure><img src='x'><figcaption>{self.sentences(1)}</figcaption></figure>"
        inner = "".join(self.part(depth + 1) for _ in range(self.g.randrange(1, 5)))
        t = self.pick("div div section")
        return f"<{t}{self.attributes('', self.own_names())}>{inner}</{t}>"

    def article(self) -> tuple[str, bool]:
        """The article, and whether it stands in an element of its own."""
        title = f"<h1>{self.words(self.g.randrange(2, 9)).capitalize()}</h1>" if self.chance(0.8) else ""
        n = self.g.choice((1, 1, 2, 3, 5, 8, 14))
        own = self.g.random()
        parts = [self.part() if own < 0.12 or self.chance(0.97) else self.prose() for _ in range(n)]
        short = self.chance(0.25)
        if short:
            tiny = self.chance(0.4)
            title = title if not tiny else f"<h1>{self.words(1)}</h1>" if self.chance(0.5) else ""
            parts = [self.pick([f"<p>{self.words(1 if tiny else 3).capitalize()}{self.pick(['.', ''])}</p>", f"<ul>{f'<li>{self.words(1)}' * self.g.randrange(1, 4)}</ul>", f"<p>{self.words(2)} <i>{self.word()}</i> {self.words(2)}<br>{self.word()}</p>"]) for _ in range(self.g.randrange(1, 4))]
            if own >= 0.12 and self.chance(0.1):
                title, parts = "", [self.words(self.g.randrange(1, 4))]
        elif self.chance(0.1):
            parts = [self.words(3).capitalize() + "."] if self.chance(0.3) else [f"<p>{self.words(self.g.randrange(1, 5)).capitalize()}.</p>"]
        for kind in ("share", "ad", "aside", "form", "comments", "nav", "notice", "footer"):
            if self.chance(0.55 if short and kind in ("comments", "aside") else 0.12):
                piece = self.chrome(kind, long=kind in ("comments", "aside", "ad", "notice") and self.chance(0.85 if short else 0.3))
                at = len(parts) if kind in ("comments", "form", "footer") else self.g.randrange(len(parts) + 1)
                parts.insert(at, piece)
        if self.chance(0.15):
            title = self.pick([f"<header y='chrome'><p>{self.said('share')}</p></header>" + title, title + self.chrome("share")])
        if own < 0.12:  # its blocks stand among the others
            title, *parts = [re.sub(r"^<(\w+)(?![^>]* y=)", r"<\1 y='text'", part) for part in (title, *parts)]
        body = title + "".join(parts)
        if self.chance(0.1):  # no paragraphs, but lines
            body = title + "<br><br>".join(self.prose() for _ in range(n + 1))
        elif own >= 0.12 and self.chance(0.06):
            t = self.pick("span div font")
            body = title + "".join(f"<{t}>{self.prose()}</{t}>" for _ in range(n))
        if own < 0.12:
            return body, False
        tag = self.pick("article article main div div div section")
        names = []
        if tag in ("div", "section"):
            names = [self.pick([self.pick(TEXT_NAMES), f"{self.pick(TEXT_NAMES)}-{self.pick(TEXT_NAMES)}", f"{self.word()}-{self.pick(TEXT_NAMES)}"])] if own < 0.6 else self.own_names()[:1]
        elif self.chance(0.4):
            names = [self.pick([self.pick(TEXT_NAMES), self.random_name(), self.pick("search post notice header promo share menu related")])]
        if self.chance(0.12):
            names.append(f"{self.pick('has with no without not is')}-{self.pick(self.pick(list(NAMES.values())))}")
        if self.chance(0.08):
            names.append(f"{self.pick('comments comment respond sharing search')}-{self.pick('open closed on off enabled disabled')}")
        if self.chance(0.3):
            inner = f"<div{self.attributes('', self.own_names())}>{body}</div>"
            body = self.pick([inner, title + f"<div{self.attributes('', self.own_names())}>{body.removeprefix(title)}</div>"])
        return f"<{tag}{self.attributes('text', names)}>{body}</{tag}>", True

    def page(self) -> str:
        syllables = [self.g.choice("bcdfghklmnprstvwz") + self.g.choice("aeiouäéó") + self.g.choice(("", "", "n", "s", "r")) for _ in range(40)]
        self.vocabulary = ["".join(self.g.choices(syllables, k=self.g.choice((1, 1, 2, 2, 3, 4)))) for _ in range(120)]
        if self.chance(0.02):
            return self.sentences(self.g.randrange(1, 9))
        article, own = self.article()
        before = [self.chrome(k) for k in ("notice", "header", "nav", "ad", "aside", "share") if self.chance(0.3)]
        after = [self.chrome(k, long=k in ("comments", "aside", "notice") and self.chance(0.15)) for k in ("comments", "aside", "form", "nav", "ad", "notice", "footer") if self.chance(0.35)]
        self.g.shuffle(before)
        body = "".join(before[: len(before) // 2]) + article
        outside, after_outside = before[len(before) // 2 :], after[len(after) // 2 :]
        body += "".join(after[: len(after) // 2])
        lines = not own and "<br><br>" in article
        for k in range(self.g.choice((0, 0, 1, 1, 2, 3, 5))):
            tag = self.pick("div div div section main" if k == 0 else "div div div section")
            names = [self.pick([self.pick(FRAME_NAMES), self.random_name(), "", self.pick(TEXT_NAMES), f"{self.pick(self.pick(list(NAMES.values())))}-{self.pick('wrap wrapper container holder')}"])]
            if self.chance(0.1):
                names.append(f"{self.pick('has with no')}-{self.pick('sidebar comments ads header share')}")
            if self.chance(0.12):
                tag = "form"
                names = [n for n in names if not any(w in n for w in NAMES["form"].split())]
            y = "text" if lines and k == 0 else "frame"
            body = f"<{tag}{self.attributes(y, names)}>{body}</{tag}>"
            if outside and self.chance(0.5):
                body = outside.pop() + body
            if after_outside and self.chance(0.5):
                body += after_outside.pop(0)
            lines = lines and y != "text"
        body = "".join(outside) + body + "".join(after_outside)
        y = "text" if lines else "frame"
        if self.chance(0.1):
            return f"<div y='{y}'>{body}</div>" if lines else body
        names = [f"{self.pick('has no with')}-{self.pick('sidebar comments ads header')}"] if self.chance(0.1) else [self.random_name()] if self.chance(0.2) else []
        if self.chance(0.5):
            body = f"<html><head><meta charset='utf-8'><title>{self.words(3)}</title></head><body{self.attributes(y, names)}>{body}</body></html>"
        else:
            body = f"<body{self.attributes(y, names)}>{body}</body>"
        return body


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """``n`` labelled pages; the first ones are the same for every ``n``."""
    layouts = _Layouts(seed)
    return [layouts.page() for _ in range(n)]
