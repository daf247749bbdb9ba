"""Left-out end tags, against a stack kept in Python."""

import random
import re

from pyspark.sql import functions as F

from pageloom.functions.html import ENDED_BY, IN_HEAD, IN_TABLE, STYLING, TOKEN, VOID, close_elements

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ENDED_BY = {name: (ended, shields) for starts, ended, shields in ENDED_BY for name in starts}


def balanced(tokens: list[str]) -> list[str]:
    """Tokens with the end tags that HTML lets one leave out, and without those that end nothing.

    An element ends at its own end tag, at a start tag that it cannot contain, or with its
    parent, whichever comes first. Styling elements are passed on as they are.
    """
    out: list[str] = []
    open_: list[str] = []

    def close_from(at: int) -> None:
        out.extend(f"</{name}>" for name in reversed(open_[at:]))
        del open_[at:]

    for token in tokens:
        m = _NAME.match(token)
        if m is None:
            out.append(token)
            continue
        name = m[1].lower()
        if name in STYLING:
            out.append(token)
        elif token[1] == "/":
            for at in range(len(open_) - 1, -1, -1):
                if open_[at] == name:
                    close_from(at + 1)
                    open_.pop()
                    out.append(token)
                    break
                if name not in IN_TABLE and open_[at] in ("td", "th", "table"):
                    break
        else:
            if open_ and open_[-1] == "head" and name not in IN_HEAD and name != "head":
                close_from(len(open_) - 1)
                ended, shields = (), ()  # a head ends alone
            else:
                ended, shields = _ENDED_BY.get(name, ((), ()))
            first = None
            for at in range(len(open_) - 1, -1, -1) if ended else ():
                if open_[at] in shields and open_[at] not in ended:
                    break
                if open_[at] in ended:
                    first = at
            if first is not None:
                close_from(first)
            out.append(token)
            if name not in VOID:
                open_.append(name)
    close_from(0)
    return out


def test_every_element_is_closed_as_by_a_stack(spark):
    rng = random.Random(5)
    names = ("div p ul ol li table tbody tr td th dl dt dd option select head body title section span b em a br img "
             "article nav h1 form button").split()
    pages = [None, "", "text", "<p>", "</p>", "<li>a<li>b", "<P CLASS='x>y'>a<DIV>b", "a < b <!-- c --> <!doctype x>"]
    for _ in range(400):
        pages.append("".join(rng.choice(("<%s>", "<%s>", "</%s>", "t<%s class='ad'>")) % rng.choice(names)
                             for _ in range(rng.randrange(1, 40))))
    pages.append("<ul>" + "<li>x<p>y" * 3000)
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    found = {r.id: r.closed for r in frame.select("id", close_elements(F.col("html")).alias("closed")).collect()}
    for k, page in enumerate(pages):
        assert found[k] == (None if page is None else "".join(balanced(re.findall(TOKEN, page)))), page
