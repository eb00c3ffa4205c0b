"""The labelled table that the trees of personal data learn from: values and the words before them.

A row is a group of values with its label. Values are patterns whose # stand for digits, drawn with a fixed seed; words
are what announces such a value. The table is data: a caller may leave out groups or give their own. Whether a case is
personal follows from its group, and from nothing that the trees look at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple


class Group(NamedTuple):
    name: str
    kind: str | None  # of personal data; null: the values are none
    words: tuple[str, ...]
    values: tuple[str, ...]
    bare: bool = False  # personal even where no word announces it


#: Numbers that aren't personal data, by what they are.
OTHERS = (
    Group("isbn", None, ("isbn", "ISBN:", "ISBN-13", "book"), ("978-#-##-######-#", "978-#-####-####-#", "978##########", "#-####-####-#")),
    Group("imei", None, ("imei", "IMEI:", "device", "handset"), ("##-######-######-#", "###############", "###### ## ###### #")),
    Group("parcel", None, ("parcel", "tracking number", "shipment", "package"), ("### ### ###", "#### #### ####", "## ### ### ###")),
    Group("invoice", None, ("invoice", "Rechnung", "factura", "bill no."), ("20######-####", "20##-######", "##########", "###-####-###")),
    Group("order", None, ("order", "Bestellung", "commande", "pedido"), ("###-#######-#######", "####-####", "#########", "###-###-####")),
    Group("coordinates", None, ("coordinates", "position", "latitude", "located at"), ("##.#### ##.####", "##.##### -#.#####", "##.###### ##.######")),
    Group("fraction", None, ("ratio", "score", "measured", "about"), ("##/##/##/##", "#/##/##/##", "##/### ##/###")),
    Group("identifier", None, ("id", "ID:", "ref.", "case", "ticket", "serial number"), ("####-####-##", "########", "###-###-###", "######.####", "### ### ####")),
    Group("amount", None, ("costs", "total", "price", "population"), ("# ### ###", "## ### ###", "###.###.###", "# ### ### ###")),
    Group("date", None, ("on", "since", "until", "dated"), ("20##-0#-1#", "1#.0#.20##", "0#/1#/19##", "20##-0#-1# 1#.3#")),
    Group("version", None, ("version", "release", "build", "v."), ("##.###.####.#", "#.#.####.##", "#.##.####")),
    Group("range", None, ("between", "from", "pages", "years"), ("19## - 20##", "19##-20##", "#### - ####")),
    Group("account", None, ("account", "contract", "policy", "Kunde"), ("#### #### ####", "########## ##", "###.###.####")),
    Group("chapter", None, ("chapter", "section", "paragraph", "item"), ("# . # . # . #", "## . # . # . ##", "#.#.## . ##")),
    Group("clock", None, ("timestamp", "epoch", "logged", "ticks"), ("17########", "17###########", "0#.1#.20## 1#.4#")),
    Group("octets", None, ("ip", "host", "server", "address"), ("1# . 2# . 4## . 7##", "10.0.5#.70#", "3## . 1 . 2 . 5##")),
)
#: Personal data in forms that the base patterns don't know.
PERSONAL = (
    Group("phone", "phone", ("tel", "tel.", "phone:", "phone", "call", "call me on", "fax", "mobile", "Telefon", "téléphone", "teléfono", "ring us at"),
          ("(2##) ###-####", "4##.###.####", "5##-###-####", "6## ### ####", "0## #### ####", "0#### ######", "0# ## ## ## ##", "7#########", "### ### ###")),
    Group("phone in brackets", "phone", ("reception", "office", "at home"), ("(2##) ###-####", "(6##) ###-####", "(9##) ###-####"), True),
    Group("card", "card", ("card", "credit card", "visa", "carte", "Karte", "tarjeta"), ("37## ###### ####L", "34#############L", "4###########L", "4###.####.####.###L", "5###/####/####/###L")),
    Group("card in groups", "card", ("paid with", "charged to"), ("4###.####.####.###L", "5###.####.####.###L"), True),
    Group("ip", "ip", ("ip", "host", "server", "address", "ip address"), ("1# . 2# . 1## . 7#", "10 . 0 . # . 1##", "1## . 1## . 1## . 1#", "8# . 9# . 1# . #")),
)
#: Names, hosts and ends of addresses whose signs are spelt out, and everyday sentences with the same words.
NAMES = ("jane.doe", "name7", "b.smith", "info", "k_lee", "max", "office", "li", "a.very.long.name", "sales-2")
HOSTS, ENDS = ("example", "mail9", "web-host", "acme", "post", "firma", "t-online", "uni", "x1"), ("com", "org", "net", "de", "info", "io", "co", "fr", "eu")
SIGNS = ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "))
PROSE = (
    "the point at the dot on the map", "look at a dot of ink", "stop at every dot and wait", "stand at this dot over there", "he looked at one dot from above", "sit at his dot with care",
    "it ended at its dot as usual", "arrive at any dot or line", "meet at each dot that glows", "stare at our dot below us", "we met at that dot between lines", "aim at your dot which blinks",
)
BEFORE = ("", "please see ", "some words before ", "he said that ", "we wrote it down: ", "this came to ")
AFTER = ("", " please", " and after", ".", ", thanks", " soon", " today", " is here", "\n")
TABLE = OTHERS + PERSONAL
SEED, REPEATS = 7, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def filled(pattern: str, rng: random.Random, right: bool = True) -> str:
    """The pattern with digits; L is the check digit, or another one."""
    value = "".join(str(rng.randint(0, 9)) if c == "#" else c for c in pattern)
    if "L" not in value:
        return value
    check = next(d for d in "0123456789" if luhn("".join(c for c in value.replace("L", d) if c.isdigit())))
    return value.replace("L", check if right else str((int(check) + rng.randint(1, 9)) % 10))


def cases(table: tuple[Group, ...] = TABLE) -> Iterator[tuple[str, str | None, int, int]]:
    """(text, kind or null, start, end) of each labelled value."""
    announcing = [w for g in table if g.kind is None and g.name not in ("octets", "date", "range") for w in g.words]
    for g in table:
        rng = random.Random(f"{SEED} {g.name}")
        hints = {k: [w for p in table if p.kind == k and not p.bare for w in p.words] for k in ("phone", "card", "ip")}

        def case(lead: str, value: str, kind: str | None, rng: random.Random = rng) -> tuple[str, str | None, int, int]:
            head = rng.choice(BEFORE) + lead + (" " if lead else "")
            return head + value + rng.choice(AFTER), kind, len(head), len(head) + len(value)

        for word in g.words:
            for pattern in g.values:
                for _ in range(REPEATS):
                    yield case(word, filled(pattern, rng), g.kind)
                if g.kind is None and g.name != "octets":  # the other kind of word, further off, doesn't count
                    far = rng.choice([h for hs in hints.values() for h in hs] or ["call"])
                    yield case(f"{far} about {word}", filled(pattern, rng), None)
                    yield case("", filled(pattern, rng), None)
                elif g.kind and announcing:
                    yield case(f"{rng.choice(announcing)} or {word}", filled(pattern, rng), g.kind)
                    if not g.bare:
                        yield case(rng.choice(announcing), filled(pattern, rng), None if "(" not in pattern and "L" not in pattern else g.kind)
                if g.bare:
                    yield case("", filled(pattern, rng), g.kind)
                if "L" in pattern:
                    yield case(word, filled(pattern, rng, False), None)
    rng = random.Random(SEED)
    for name in NAMES:
        for host in HOSTS:
            for at, dot in SIGNS:
                lead, value = rng.choice(("", "", "write to ", "mail ", "contact ", "Kontakt: ")), f"{name}{at}{host}{dot}{rng.choice(ENDS)}"
                head = rng.choice(BEFORE) + lead
                yield head + value + rng.choice(AFTER), "email", len(head), len(head) + len(value)
    for sentence in PROSE:
        for before in BEFORE:
            yield before + sentence, None, len(before), len(before) + len(sentence)
