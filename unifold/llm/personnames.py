"""Reading personal names: tokens, given names, initials and family names."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from unifold.llm.metric import typing_cost
from unifold.llm.standins import stand_in

# Usual short and variant forms of given names.
NICKNAMES = {
    "abigail": "abby gail", "agnieszka": "aga agnes", "alejandro": "alex jandro ale", "aleksandra": "sasha sasza ola alex",
    "alexander": "alex sasha sasza xander sandy alec lex", "alexandra": "alex sandra sasha alexa lexi", "alfred": "alf fred alfie", "alice": "ali",
    "allison": "ally ali allie", "amanda": "mandy", "amelia": "amy millie", "anastasia": "nastya stasia ana", "andrew": "andy drew",
    "angela": "angie", "anna": "annie anya ania ann", "anselm": "selmo", "anthony": "tony antony", "antonio": "toni tonio nino", "aoife": "eefa",
    "arthur": "art artie", "augustus": "gus august", "barbara": "barb babs basia bobbie", "beatrice": "bea trixie", "benedict": "ben",
    "benjamin": "ben benny benji", "birgit": "gitte britt", "bogdan": "bodya", "bradley": "brad", "caroline": "carol carrie caro lina",
    "catherine": "cathy cate cat kate katie kitty", "cecilia": "cece celia", "charles": "charlie chuck charley karl",
    "charlotte": "charlie lottie lotte", "chiara": "kia", "christian": "chris", "christina": "chris tina christa", "christopher": "chris kit topher",
    "cosmin": "cos", "cynthia": "cindy", "daniel": "dan danny dany", "darius": "dario", "david": "dave davy dafydd", "deborah": "deb debbie debby",
    "diana": "di", "dmitri": "dima mitya dmitry", "dominic": "dom nick", "donald": "don donny", "dorothy": "dot dottie dolly",
    "edward": "ed ted eddie ned teddy", "ekaterina": "katya kate katerina", "eleanor": "ellie nell nora lenora", "elena": "lena",
    "elizabeth": "liz beth betty lizzie eliza libby lisa elsie", "emily": "em emmy", "enrique": "quique", "ernest": "ernie", "eugene": "gene",
    "ferdinand": "ferdi", "fiona": "fi", "florence": "flo florrie", "frances": "fran frannie francie", "francesco": "franco checco cesco",
    "francis": "frank fran", "francisco": "paco pancho kiko fran", "frederick": "fred fritz freddie rick freddy friedrich", "gabriel": "gabe",
    "gabriela": "gabi gaby", "george": "georgie geordie", "gerard": "gerry gerd", "giovanni": "gianni vanni nino", "giuseppe": "pino beppe peppe",
    "gregory": "greg", "gwen": "gwendolyn", "harold": "harry hal", "heinrich": "heinz heiner", "helena": "lena helen",
    "henrietta": "etta hattie hetty harriet", "henry": "harry hank hal", "herbert": "bert herb", "ilse": "ilsa", "isabella": "bella izzy isa",
    "ivan": "vanya", "jacob": "jake jakob", "jacqueline": "jackie", "james": "jim jamie jimmy", "janina": "nina jana",
    "jeffrey": "jeff geoff geoffrey", "jennifer": "jen jenny", "jeremy": "jerry jez", "jessica": "jess jessie", "joanna": "jo asia joan",
    "johannes": "hans hannes jan johann", "john": "jack johnny jon", "jonathan": "jon jonny nathan", "jose": "pepe", "joseph": "joe joey jo",
    "josephine": "josie jo", "joshua": "josh", "judith": "judy", "julia": "julie jules", "katarzyna": "kasia",
    "katherine": "kate kathy katie kat kit", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry laurie", "leonard": "leo len lenny",
    "leonardo": "leo leon nardo", "lillian": "lily lil", "louis": "lou louie", "ludmila": "mila luda lyuda", "lukasz": "luka luke",
    "madeleine": "maddie maddy lena", "magdalena": "magda lena maddie", "manuel": "manolo manu", "marcus": "marc mark",
    "margaret": "maggie peggy meg greta margie marge rita", "maria": "mia mary marie", "martin": "marty", "matthew": "matt matty",
    "maximilian": "max maxi", "melissa": "mel missy", "michael": "mike mick mickey micky", "mikhail": "misha", "mireille": "mimi",
    "nadia": "nadya nadja", "natalia": "natasha nat talia", "nathaniel": "nate nat nathan", "nicholas": "nick nicky nico klaus",
    "nicole": "nicky nikki", "nikolai": "kolya", "oksana": "ksenia oksi", "oliver": "ollie olly", "oluwaseun": "seun", "pamela": "pam",
    "patricia": "pat trish patty tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "quentin": "quin", "raymond": "ray",
    "rebecca": "becky becca", "reginald": "reg reggie", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "roberto": "beto",
    "ronald": "ron ronnie", "rudolf": "rudi", "samantha": "sam sammy", "samuel": "sam sammy", "sebastian": "seb basti", "sergei": "seryozha serge",
    "stephanie": "steph steffi stevie", "stephen": "steve steven stevie", "susan": "sue susie suzy", "tatiana": "tanya", "terence": "terry",
    "teresa": "terri tess tessa", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "umberto": "berto",
    "ursula": "uschi ulla", "valentina": "vale tina val", "vanessa": "nessa", "veronica": "ronnie vera", "victor": "vic",
    "victoria": "vicky tori vic", "vikram": "vik vicky", "vincent": "vince vinnie", "vladimir": "vova volodya", "walter": "walt wally",
    "wilhelmina": "mina willa minnie billie", "william": "will bill billy liam willy", "xavier": "xavi", "yevgenia": "zhenya genia evgenia",
    "yusuf": "yousef", "zachary": "zack zach", "zofia": "zosia sofia", "zoltan": "zoli",
}
# Words in names that belong to neither the given nor the family name.
_TITLES = frozenset("mr mrs ms miss mx dr prof sir dame herr frau hr fr sra sr srta mme mlle ing dipl mag med jr jnr snr phd msc bsc ba ma mba md dds esq pe pmp cpa ii iii iv they them she her he his".split())
_PARTICLES = frozenset("de del della der den di da do dos du la le van von zu zur af av al el bin ibn".split())

_EXTRA = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "`": "'"})


def fold(text: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", text.lower().translate(_EXTRA))
    return "".join(c for c in s if not unicodedata.combining(c))


def without_umlauts(word: str) -> str:
    """ae, oe and ue as a, o and u: the common form of both ways to write an umlaut."""
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _split(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", text.replace("'", "")) if t]


class GivenNames:
    """Known given names: formal names with their short forms, and those learned from a corpus.

    ``pivots(token)`` gives the formal names a token may stand for, with the number of slips.
    """

    def __init__(self, learned: list[str] = ()):
        self.formal: dict[str, set[str]] = {}
        for name, shorts in NICKNAMES.items():
            for s in [name, *shorts.split()]:
                self.formal.setdefault(fold(s), set()).add(fold(name))
        for name in learned:
            self.formal.setdefault(name, {name})
        self.by_deletion: dict[str, set[str]] = {}
        for n in self.formal:
            if len(n) >= 3:
                for d in _once_deleted(n):
                    self.by_deletion.setdefault(d, set()).add(n)
        self.pivots = lru_cache(maxsize=200_000)(self._pivots)

    def _pivots(self, token: str) -> tuple[tuple[str, int], ...]:
        if token in self.formal:
            return tuple((p, 0) for p in sorted(self.formal[token]))
        if len(token) < 3:
            return ()
        near = {n for d in _once_deleted(token) for n in self.by_deletion.get(d, ())}
        close = [n for n in near if typing_cost(token, n)[0] <= 1]
        return tuple((p, 1) for p in sorted({p for n in close for p in self.formal[n]}))

    def beginning_with(self, initial: str) -> list[str]:
        """Formal names that have a form with this initial."""
        return sorted({p for n, ps in self.formal.items() if n[0] == initial for p in ps})


def _once_deleted(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@dataclass(frozen=True)
class Reading:
    """One way to read a name: its formal given name (or initial), the slips in it, its family name."""

    pivot: str
    slips: int
    family: str
    initial_only: bool = False


def segments(name: str) -> list[list[str]]:
    """Tokens by comma-separated part, without titles, degrees, particles and brackets."""
    text = fold(re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", name))
    parts = [[t for t in _split(p) if t not in _TITLES and t not in _PARTICLES and not t.isdigit()] for p in text.split(",")]
    return [p for p in parts if p]


def readings(name: str | None, givens: GivenNames) -> list[Reading]:
    """All sensible readings of a name; none for stand-ins and single words.

    Initials stand for a given name only where no longer given name is there. If neither word is
    a known given name, each of them may be one.
    """
    if name is None or stand_in(name):
        return []
    parts = segments(name)
    every = [t for p in parts for t in p]
    words, initials = [t for t in every if len(t) > 1], [t for t in every if len(t) == 1]
    if not words:
        return []
    if len(words) == 1:
        return [Reading(f"i:{i}", 0, words[0], True) for i in initials[:1]]
    if len(parts) > 1 and [t for t in parts[0] if len(t) > 1] and [t for t in parts[1] if len(t) > 1]:
        family = [t for t in parts[0] if len(t) > 1]
        orders = [([t for t in parts[1] if len(t) > 1][0], "".join(family))]
    else:
        orders = [(words[0], words[-1]), (words[-1], words[0])]
    known = [(g, f, givens.pivots(g)) for g, f in orders]
    best = min((s for _, _, ps in known for _, s in ps), default=None)
    if best is None:
        g, f = orders[0]
        return [Reading(f"?{g}", 0, f), Reading(f"?{f}", 0, g)]
    return [Reading(p, s, f) for g, f, ps in known for p, s in ps if s == best]
