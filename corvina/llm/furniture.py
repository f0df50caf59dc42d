"""What a line of page furniture looks like by itself.

Only the seeds of the classifier of :mod:`corvina.llm.boilerplate` and the
cheap first cut of operators that need the article text but not its exact
borders.
"""

from __future__ import annotations

import re

#: Share of a source's rows from which a line counts as its furniture.
FURNITURE_SHARE = 0.02

# Fixed values, in lower case: how lines of a page, not of an article, commonly begin.
STARTS = re.compile(
    r"""(?x) ^\W* (?:
      tags?\s*: | assuntos\s*: | palavras-chave\s*: | t[óo]picos\s*:
    | leia\s+(?:tamb[ée]m|mais)\b | veja\s+(?:mais|tamb[ée]m)\b | relacionad[ao]s?\s*: | saiba\s+mais\b | mais\s+lidas\b
    | fotos?\s*: | imagem\s*: | legenda\s*: | cr[ée]ditos?\s*: | v[íi]deo\s*: | com\s+informa[çc][õo]es\s+d[eoa]\s | da\s+reda[çc][ãa]o\b
    | edi[çc][ãa]o\s*: | revis[ãa]o\s*: | colabor(?:ou|aram)\s | reportagem\s+de\s
    | publicado\s+em\b | atualizado\s+em\b | tempo\s+de\s+leitura\b | coment[áa]rios?\b.{0,20}$ | \w+\s+comentou\s*:
    | [\w:][\w: ]{1,23}\s[»>/]\s\S | publicidade\W*$ | an[úu]ncio\W*$ | assine\b | compartilh[ea]\b | copyright\b | © | todos\s+os\s+direitos | usamos\s+cookies
    )"""
)
# Parts that no sentence of an article has.
PARTS = ("(crédito", "( ) ", "direitos reservados", "política de privacidade", "newsletter")
#: A byline with place and time.
DATED = re.compile(r"\|\s*\d{1,2}\s+\w{3}\.?\s+\d{4}\s+\d{1,2}h\d{2}")
#: Menus: short labels between separators or wide gaps.
MENU = re.compile(r"^\W*\w[\w'’ -]{0,24}(?:\s*(?:[|•·/»>]|\s{2,})\s*\w[\w'’ -]{0,24}){2,}\W*$")
ENDED = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")


def seed_furniture(line: str, low: str | None = None, ended: bool | None = None) -> bool:
    """Whether a line shows by its own words (``low``: in lower case) that it is furniture."""
    low = line.lower() if low is None else low
    if STARTS.match(low):
        return True
    for part in PARTS:
        if part in low:
            return True
    if "|" in line and DATED.search(low):
        return True
    ended = line[-1:] in ".!?…" or ENDED.search(line[-16:]) is not None if ended is None else ended
    return not ended and MENU.match(line) is not None
