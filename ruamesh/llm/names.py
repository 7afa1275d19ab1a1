"""Variant spellings of street names that people typed: every name is rewritten to canonical forms and equi-joined.

Parsing undoes what order and dress do: the kind of way in front, behind a comma or in parentheses and however
abbreviated, "Surname, Given" turned round, titles, organisations and their legal forms spelled out, numbers kept.
Then the *rewriting rules* give each name its forms:

* a given name stands for itself, for the names it is a nickname of (by a table of common ones, and by the rules of
  clipping and diminutives for all others), and for its initial;
* a token is rewritten to more frequent tokens that a slip or two away (letters swapped, doubled, left out, struck
  wrong, or spelled by ear) give it; candidates meet in an equi-join of deletion forms. Tokens of three letters or
  fewer are too short to tell a slip from another name and stay as they are;
* a missing kind of way stands for any.

Forms are exploded and equi-joined with the forms that the fully written streets have. A form that several streets
share says little: each match is scored by the information of its form (log2 of the streets that share it) and by the
cost of the rewriting, a slip counting ``SLIP_BITS``; the best wins, and where two streets stay equally good the name
is linked to neither. The membership of names in streets is the primary result (``street_ids``); pairs come from it.

Defined results: null and blank names and placeholders mean no street; names of one spelling count once, however
many rows have it; names that no other form matches stand alone and give no row. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup

#: Fixed values, lower case without accents: kinds of way and how they are written; a bus corridor is an avenue.
KINDS = {
    "rua": "rua r",
    "avenida": "avenida av avda aven corredor corr cor",
    "travessa": "travessa trav tr tv",
    "alameda": "alameda alam al",
    "praca": "praca pca pc pr",
    "largo": "largo lgo lg",
    "estrada": "estrada estr est",
    "beco": "beco bc b",
    "rodovia": "rodovia rod",
    "viela": "viela vl",
    "ladeira": "ladeira lad",
    "viaduto": "viaduto vd",
    "passagem": "passagem pass",
    "acesso": "acesso ac",
}
#: What may stand between "corredor" and the name.
CORRIDOR = "exclusivo excl exc de do da dos onibus on bus brt transp transporte col coletivo"
#: Titles and how they are written.
TITLES = {
    "marechal": "marechal mal mar",
    "general": "general gen gal",
    "coronel": "coronel cel",
    "almirante": "almirante alm",
    "capitao": "capitao cap",
    "major": "major maj",
    "tenente": "tenente ten",
    "brigadeiro": "brigadeiro brig",
    "professor": "professor prof profo professora profa profª",
    "doutor": "doutor dr doutora dra",
    "engenheiro": "engenheiro eng engo engenheira enga",
    "vereador": "vereador ver vereadora vera",
    "deputado": "deputado dep deputada depa",
    "senador": "senador sen",
    "governador": "governador gov",
    "presidente": "presidente pres",
    "padre": "padre pe",
    "dona": "dona d da",
    "dom": "dom",
    "frei": "frei fr",
    "sao": "santo santa sao sto sta",
    "comendador": "comendador com comend comen",
    "barao": "barao bar",
    "visconde": "visconde visc",
}
#: Organisations by their two words, with the ways of writing each.
ORGANISATIONS = {
    "associacao": "associacao assoc ass",
    "federacao": "federacao fed feder",
    "irmandade": "irmandade irm irmand",
    "cooperativa": "cooperativa coop cooper",
    "sociedade": "sociedade soc",
    "companhia": "companhia cia comp",
    "fundacao": "fundacao fund",
    "instituto": "instituto inst",
    "sindicato": "sindicato sind",
    "clube": "clube cl",
}
#: Legal forms that add nothing behind an organisation's name.
LEGAL = "ltda sa s/a me eireli epp s.a"
#: Common given names of the language and their nicknames, lower case without accents. Names beyond the
#: table are clipped and made small by ``clipped``.
NICKNAMES = {
    "adelaide": "dede laide adelinha",
    "adriana": "adri dri drica",
    "adriano": "dri drico",
    "afonso": "fonso fonsinho",
    "agostinho": "gusto tinho",
    "alberto": "beto betinho berto",
    "alessandra": "ale sandra",
    "alexandre": "ale xande xandinho alex",
    "alfredo": "fredo fredinho",
    "alice": "lili licinha alicinha",
    "aline": "lili nine",
    "amanda": "mandinha manda",
    "ana": "aninha nana",
    "anderson": "andy dede",
    "andre": "dede andrezinho",
    "andrea": "dea deinha",
    "angela": "ange angelinha",
    "anselmo": "selmo",
    "antonio": "tonico toninho tonho totonho tom toni",
    "aparecida": "cida cidinha",
    "arlindo": "lindo",
    "armando": "mandinho",
    "arnaldo": "naldo naldinho",
    "arthur": "tuca tutu",
    "augusto": "guto gugu",
    "beatriz": "bia be biazinha",
    "benedito": "dito bene ditinho",
    "bento": "bentinho",
    "bernardo": "be beco nado bernardinho",
    "bruno": "bruninho",
    "caetano": "cae tano caco",
    "camila": "mila camilinha ca",
    "carlos": "carlao carlinhos caca carlito cadu",
    "carolina": "carol lina caca",
    "catarina": "cata catita cat",
    "cecilia": "cica cilinha ceci",
    "celia": "celinha",
    "celso": "celsinho",
    "cesar": "cesinha",
    "clara": "clarinha",
    "claudia": "cau claudinha",
    "claudio": "claudinho",
    "cristiano": "cris",
    "cristina": "cris tina",
    "daniel": "dani dan",
    "daniela": "dani",
    "david": "dede davi",
    "debora": "deb debs",
    "delfina": "fina delfininha",
    "denise": "de deni",
    "diego": "di dieguinho",
    "diogo": "dioguinho",
    "dolores": "lola dolorinhas lolita",
    "domingos": "mingo minguinho dominguinhos",
    "edson": "edinho",
    "eduardo": "edu dudu duda eduardinho",
    "eliane": "lili elia",
    "elias": "lia",
    "elisabete": "bete beth betinha lisa elis",
    "emilia": "mila mimi emi",
    "emilio": "milo",
    "erico": "riquinho",
    "ernesto": "neto nesto ernestinho",
    "estela": "tela",
    "eugenia": "gegenia",
    "eugenio": "geninho",
    "eunice": "nice nicinha",
    "fabiana": "fabi bia",
    "fabio": "fabinho",
    "fabricio": "fafa bricio",
    "felipe": "lipe felipinho fe",
    "felisberto": "feli berto betinho",
    "fernanda": "nanda fe fefe",
    "fernando": "nando fe nandinho",
    "flavia": "flavinha fla",
    "flavio": "flavinho",
    "francisco": "chico chiquinho xico quico paco",
    "gabriela": "gabi gabizinha bibi",
    "geraldo": "gege geraldinho",
    "gilberto": "giba gil beto",
    "gloria": "glorinha",
    "gregorio": "grego gori greg",
    "guilherme": "gui guiga guilherminho",
    "guiomar": "guio",
    "gustavo": "guga guto gu",
    "helena": "lena leninha leleca",
    "henrique": "rique ique henriquinho kiko",
    "herminia": "mina minia hermi",
    "hugo": "huguinho",
    "humberto": "beto berto",
    "inacio": "nacio inacinho naco",
    "ines": "inesinha",
    "irene": "nene rene ireninha",
    "isabel": "bel belinha isa bebel",
    "ivone": "vone",
    "jaime": "jaiminho",
    "joana": "jo joaninha",
    "joao": "joaozinho jango janjao joca",
    "joaquim": "quim quincas quinzinho joca",
    "jorge": "jorginho",
    "jose": "ze zeca juca zezinho zequinha",
    "josefa": "zefa zefinha",
    "juliana": "ju juju",
    "juliano": "ju",
    "julio": "julinho juca",
    "laura": "laurinha lau",
    "leandro": "le leo",
    "leonardo": "leo nardo",
    "leopoldo": "leo poldo leozinho",
    "leticia": "le leti",
    "lourdes": "lurdinha",
    "lucas": "luquinhas lu",
    "lucia": "lu lucinha",
    "luciana": "lu lulu",
    "luis": "lula luisinho lu luizinho",
    "luisa": "lu luisinha lulu isa",
    "manuel": "mane maneco manu manezinho maneca",
    "marcelo": "celo marcelinho",
    "marcia": "marcinha",
    "marcos": "marquinhos",
    "margarida": "guida magui margo maga",
    "maria": "mari maricota mariquinha",
    "mariana": "mari nana",
    "mario": "marinho",
    "marta": "martinha",
    "mateus": "teus mateusinho",
    "mauricio": "mau ricio mauricinho",
    "miguel": "miguelito guel",
    "monica": "moni mo",
    "natalia": "nati talia naty",
    "nelson": "nelsinho",
    "nicolau": "nico lau nicolauzinho",
    "norberto": "beto berto norba nonô",
    "olivia": "livia oli vivi",
    "orlando": "lando",
    "osmar": "mazinho osmarzinho mar",
    "oswaldo": "vado waldo",
    "otavio": "tavinho tavo tato",
    "patricia": "pati pat ticia",
    "paula": "paulinha",
    "paulo": "paulinho",
    "pedro": "pedrinho pedroca pepe pedrao",
    "plinio": "plininho nino",
    "rafael": "rafa fael",
    "raimundo": "mundico mundinho rai raimundinho",
    "raquel": "quel rachel",
    "regina": "rege gina",
    "renato": "rena natinho",
    "ricardo": "rica cadinho",
    "rita": "ritinha",
    "roberto": "beto betinho robertinho bob",
    "rodrigo": "digo rodriguinho",
    "rogerio": "rogerinho gero",
    "ronaldo": "naldo roni",
    "rosalia": "rosa lia rosinha",
    "sandra": "sandrinha",
    "sebastiao": "tiao bastiao tiaozinho",
    "sergio": "serginho",
    "severino": "bio biu nino severo",
    "silvia": "silvinha",
    "simone": "mone si",
    "sofia": "sofi fifi so",
    "sonia": "soninha",
    "tania": "taninha",
    "tatiana": "tati",
    "teodoro": "teo doro",
    "teresa": "tete teca terezinha tere",
    "tereza": "teca tete",
    "tiago": "ti tiaguinho",
    "tiberio": "tibe berio",
    "tomas": "tom tomasinho",
    "valentina": "tina vale val",
    "vanessa": "nessa van",
    "vera": "verinha",
    "vicente": "vice cente vicentinho",
    "virgilio": "gilo virgi vivi",
    "vitor": "vitinho vito",
    "viviane": "vivi vi",
    "walter": "valtinho",
    "wilson": "wilsinho",
    "zelia": "zelinha",
}
_PLACEHOLDER = re.compile(r"(sem|s/?|nao tem|s\.) ?(nome|n|denominacao|nome definido|identificacao|denom)|(rua|via|logradouro|avenida|travessa|estrada)? ?(sem|s/) ?(nome|denominacao|identificacao|n)|n/?[dai]|nao (informado|identificad[oa]|consta|disponivel|ha)|desconhecid[oa]|ignorad[oa]|none|null|nan|na|unnamed|no name|unknown|indefinid[oa]|a definir|x+|nome|tbd|todo|projetada|vazio")


def plain(s: str) -> str:
    """Lower case, without accents, with single blanks."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", s).strip()


def by_ear(s: str) -> str:
    """A token as it sounds; the same for spellings that sound alike."""
    for a, b in (("ph", "f"), ("lh", "li"), ("nh", "ni"), ("ch", "x"), ("sh", "x"), ("qu", "k"), ("c", "k"), ("w", "v"), ("y", "i"), ("z", "s"), ("h", "")):
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


_KIND = {w: k for k, v in KINDS.items() for w in v.split()}
_TITLE = {w: k for k, v in TITLES.items() for w in v.split()}
_ORG = {w: k for k, v in ORGANISATIONS.items() for w in v.split()}
_CORRIDOR, _LEGAL = frozenset(CORRIDOR.split()), frozenset(LEGAL.split())
_NICK: dict[str, list[str]] = {}
for _name, _nicks in NICKNAMES.items():
    for _nick in _nicks.split():
        _NICK.setdefault(_nick, []).append(_name)


_GIVEN = frozenset(NICKNAMES) | frozenset(_NICK)


def slips(a: str, b: str, most: int = 2) -> int:
    """Fewest letters left out, put in, exchanged or swapped with their neighbour; most + 1 where it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def parse(name: str | None) -> tuple[str, str, str, str, str] | None:
    """(kind, title, first, middle, last) of a name; a number is a last of digits alone. None for no street."""
    s = plain(name or "")
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", s)
    if not bare or _PLACEHOLDER.fullmatch(bare):
        return None
    kind = ""
    # The kind of way behind: "X, rua" or "X (rua)".
    m = re.search(r"(?:,\s*([a-z. ]+?)|\(([a-z. ]+?)\))[\W_]*$", s)
    if m:
        lead, *rest = re.findall(r"[a-z]+", m.group(1) or m.group(2)) or [""]
        if lead in _KIND and (not rest or lead[:3] == "cor" and _CORRIDOR.issuperset(rest)) and not (len(lead) == 1 and _KIND.get(s.split()[0].strip(".,"))):
            kind, s = _KIND[lead], s[: m.start()]
    s = s.replace("nº", "").replace("n°", "")
    head, comma, tail = s.partition(",")
    words = lambda t: [w for w in re.split(r"[^\w/]+", t.replace("_", " ")) if w]
    a, b = words(head), words(tail)
    # A single letter before one word is an initial: people have a given name.
    if not kind and a and a[0] in _KIND and (len(a) > 1 or b) and not (len(a[0]) == 1 and len(a) == 2 and not b and not a[1].isdigit()):
        first = a.pop(0)
        kind = _KIND[first]
        if first in ("corredor", "corr", "cor"):
            while len(a) > 1 and a[0] in _CORRIDOR:
                a.pop(0)
            if len(a) > 1 and a[0] in _KIND and _KIND[a[0]] == "avenida":
                a.pop(0)
    if b and b[0] in _KIND and not kind and len(b) > 1:
        kind = _KIND[b.pop(0)]
    tokens = b + a if comma and b else a
    while tokens and tokens[-1] in _LEGAL:
        tokens.pop()
    tokens = [t for t in tokens if t not in ("no", "num", "numero", "n")] if any(t.isdigit() for t in tokens) else tokens
    if len(tokens) == 1 and tokens[0].isdigit():
        return kind, "", "", "", tokens[0].lstrip("0") or "0"
    if not tokens or _PLACEHOLDER.fullmatch(" ".join(tokens)):
        return None
    title = ""
    if tokens[0] in _TITLE and (len(tokens) > 2 or len(tokens[0]) > 1):
        # "D." before a given name or an initial is a title, before anything else an initial itself.
        if len(tokens[0]) > 1 or len(tokens[1]) == 1 or any(slips(tokens[1], g) <= 2 for g in _GIVEN):
            title = _TITLE[tokens.pop(0)]
    if len(tokens) > 2 and tokens[0] in _ORG:
        return kind, "", _ORG[tokens[0]], tokens[1], tokens[-1]
    if len(tokens) == 1:
        return kind, title, "", "", tokens[0]
    return kind, title, tokens[0], " ".join(tokens[1:-1]), tokens[-1]


_PARSED = "name string, n bigint, kind string, title string, first string, middle string, last string"
#: Bits that a slip counts in the score of a match.
SLIP_BITS = 8
#: Spellings of one street that share a slot when pairs are made.
PER_SLOT = 500
#: A rare token is rewritten to one that stands in this many times as many contexts, or rows where both are rare.
TIMES = 3.0


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(s, n, *p) for s, n in zip(pdf["name"], pdf["n"]) if (p := parse(s))]
        yield pd.DataFrame(rows, columns=["name", "n", "kind", "title", "first", "middle", "last"])


def deletions(token: str) -> set[str]:
    """What is left of a token as written without one letter, and as heard without up to two."""
    ear = by_ear(token)
    out = {"w" + token} | {"w" + token[:k] + token[k + 1 :] for k in range(len(token))} | {"e" + ear}
    one = {ear[:k] + ear[k + 1 :] for k in range(len(ear))}
    out |= {"e" + x for x in one}
    if len(ear) > 6:
        out |= {"e" + x[:k] + x[k + 1 :] for x in one for k in range(len(x))}
    return out


def clipped(given: str) -> set[str]:
    """What a given name is cut down to or made small by, for names beyond the table: Rafa, Nando, Marquinhos."""
    stem = given.rstrip("aeiou") if len(given) > 4 else given
    small = {stem + end for end in ("inho", "inha", "inhos", "zinho", "zinha", "ito", "ita", "ao")} | {given + "zinho", given + "zinha"}
    return {given[:k] for k in range(3, len(given) - 1)} | {given[k:] for k in range(1, len(given) - 3)} | small if len(given) > 4 else small


def cost(a: str, b: str) -> float:
    """Slips from one token to another, as written or (a little dearer) as heard; more than 2 is too many."""
    most = 2 if min(len(a), len(b)) > 6 else 1
    got = min(slips(a, b, most), slips(by_ear(a), by_ear(b), most) + 0.5)
    return got if got <= most + 0.5 else 9.0


def token_rewrites(tokens: DataFrame) -> DataFrame:
    """(tok, to, cost) from (tok, w, ctx): w rows, ctx contexts. Every token may be rewritten to, by a rarer one."""
    tokens = tokens.repartition(_width(tokens), F.xxhash64("tok"))  # few rows in, many out

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, w, c, f) for t, w, c in zip(pdf["tok"], pdf["w"], pdf["ctx"]) if len(t) > 3 and not t.isdigit() for f in deletions(t)]
            yield pd.DataFrame(out, columns=["tok", "w", "ctx", "form"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(cost=[cost(a, b) for a, b in zip(pdf["tok"], pdf["to"])])
            yield pdf[pdf["cost"] <= 2.5]

    forms = cut(tokens.mapInPandas(explode, "tok string, w bigint, ctx bigint, form string"))
    to = forms.select(F.col("tok").alias("to"), F.col("w").alias("tw"), F.col("ctx").alias("tctx"), "form")
    more = (F.col("tctx") >= TIMES * F.col("ctx")) | (F.col("ctx") <= 2) & (F.struct("tw", "to") > F.struct("w", "tok")) & ((F.col("tctx") <= 2) | (F.col("tctx") > F.col("ctx")))
    pairs = forms.join(to, "form").filter((F.col("tok") != F.col("to")) & more).select("tok", "to").distinct()
    return pairs.repartition(_width(pairs), F.xxhash64("tok", "to")).mapInPandas(check, "tok string, to string, cost double")


def clippings(tokens: DataFrame) -> DataFrame:
    """(tok, to, cost): tokens outside the table that are clipped from a more frequent one outside it, from (tok, w, ctx)."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, c, f) for t, c in zip(pdf["tok"], pdf["ctx"]) if not t.isdigit() for f in clipped(t) - {t}]
            yield pd.DataFrame(out, columns=["to", "tctx", "tok"])

    other = tokens.filter(~F.col("tok").isin(*sorted(_GIVEN, key=str)) & ~F.col("tok").isin(*ORGANISATIONS))
    made = other.repartition(_width(other), F.xxhash64("tok")).mapInPandas(explode, "to string, tctx bigint, tok string")
    return made.join(other, "tok").filter(F.col("tctx") >= TIMES * F.col("ctx")).select("tok", "to", F.lit(0.75).alias("cost"))


def _width(df: DataFrame) -> int:
    """Partitions for work in Python, whatever the few rows before it were coalesced to."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _conflict(a: str, b: str) -> F.Column:
    """Middle names that can't be the same: neither begins with the other (as initials do), and they are far apart."""
    x, y = F.col(a), F.col(b)
    return (x != "") & (y != "") & ~F.startswith(x, y) & ~F.startswith(y, x) & (F.levenshtein(x, y) > 3)


def _best(matches: DataFrame, key: list[str], heavier: bool = False) -> DataFrame:
    """One match for each key: the least score; then the street of more rows, or none where two are equally good."""
    scored = matches.filter(~_conflict("middle", "tmiddle"))
    same = F.when((F.col("middle") != "") & (F.substring("middle", 1, 1) == F.substring("tmiddle", 1, 1)), -0.25).otherwise(0.0) + F.when((F.col("title") != "") & (F.col("title") == F.col("ttitle")), -0.25).when((F.col("title") != "") & (F.col("ttitle") != ""), 0.5).otherwise(0.0)
    one = scored.groupBy(*key, "sid").agg(F.min(F.col("cost") + same).alias("score"), F.max("tw").alias("tw"))
    rank = W.partitionBy(*key).orderBy("score", F.desc("tw"), "sid")
    ranked = one.withColumn("rank", F.row_number().over(rank)).withColumn("next", F.lead("score").over(rank)).filter("rank = 1")
    return ranked.filter(F.lit(heavier) | F.expr("next IS NULL OR next > score")).select(*key, "sid")


def _follow(step: DataFrame) -> DataFrame:
    """(sid, to) with the chains cut short: jumps double until none leads on; a circle ends after as many as any chain could need."""
    step = cut(step)
    for _ in range(step.count().bit_length()):
        nxt = step.select(F.col("sid").alias("to"), F.col("to").alias("to2"))
        if step.join(nxt, "to", "left_semi").isEmpty():
            break
        step = cut(step.join(nxt, "to", "left").select("sid", F.coalesce("to2", "to").alias("to")))
    return step


def street_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, sid): the street that each distinct name means; placeholders are left out."""
    distinct = names.select(F.col(column).cast("string").alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parsed = cut(distinct.repartition(F.hash("name")).mapInPandas(_parse, _PARSED))
    lasts = parsed.groupBy(F.col("last").alias("tok")).agg(F.sum("n").alias("w"), F.count_distinct("kind", "first").alias("ctx"))
    firsts = cut(parsed.filter("length(first) > 1").groupBy(F.col("first").alias("tok")).agg(F.sum("n").alias("w"), F.count_distinct("kind", "last").alias("ctx")))
    fixes_last = cut(token_rewrites(lasts))
    fixes_first = cut(token_rewrites(firsts))
    # Fixed and small: the table of nicknames.
    nick = names.sparkSession.createDataFrame([(k, v) for k, vs in sorted(_NICK.items()) for v in vs], "nick string, given string")
    own = firsts.select("tok", F.col("tok").alias("to"), F.lit(0.0).alias("cost")).unionByName(fixes_first)
    called = cut(own.join(F.broadcast(nick), F.col("to") == F.col("nick")).select("tok", F.col("given").alias("to"), (F.col("cost") + 0.5).alias("cost")).unionByName(clippings(firsts)).groupBy("tok", "to").agg(F.min("cost").alias("cost")))
    f = fixes_last.select(F.col("tok").alias("last"), F.col("to").alias("last2"), F.col("cost").alias("c2"))

    def rewritten(df: DataFrame, given: DataFrame) -> DataFrame:
        """The rows under every rewriting of given name and last word, as first2 and last2, with its cost."""
        g = given.select(F.col("tok").alias("first"), F.col("to").alias("first2"), F.col("cost").alias("c1"))
        a = lookup(df, g, ["first"]).unionByName(df.withColumns({"first2": F.col("first"), "c1": F.lit(0.0)}))
        b = lookup(a, f, ["last"]).unionByName(a.withColumns({"last2": F.col("last"), "c2": F.lit(0.0)}))
        return b.withColumn("cost", F.col("c1") + F.col("c2"))

    def targets(df: DataFrame) -> DataFrame:
        return df.select("kind", F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("middle").alias("tmiddle"), F.col("title").alias("ttitle"), F.col("w").alias("tw"), "sid")

    def moves(df: DataFrame, given: DataFrame, to: DataFrame, heavier: bool) -> DataFrame:
        met = rewritten(df.drop("sid"), given).filter("first2 <> first OR last2 <> last").join(targets(to), ["kind", "first2", "last2"])
        return _follow(_best(met, ["kind", "first", "last"], heavier).select(F.concat_ws("|", "kind", "first", "last").alias("sid"), F.col("sid").alias("to")))

    # Fully written streets: slips lead to the right spelling first, then nicknames to the given name.
    full = parsed.filter("kind <> '' AND length(first) <> 1")
    streets = cut(full.groupBy("kind", "first", "last").agg(F.sum("n").alias("w"), F.max_by("middle", F.struct(F.length("middle") > 1, "n", "middle")).alias("middle"), F.max_by("title", F.struct(F.col("title") != "", "n", "title")).alias("title")).withColumn("sid", F.concat_ws("|", "kind", "first", "last")))
    slipped = moves(streets, fixes_first, streets, True)
    right = cut(streets.join(slipped, "sid", "left_anti"))
    nicked = moves(right, called, right, False)
    both = slipped.join(nicked.select(F.col("sid").alias("to"), F.col("to").alias("to2")), "to", "left").select("sid", F.coalesce("to2", "to").alias("to")).unionByName(nicked)
    final = cut(streets.join(both, "sid", "left").withColumn("to", F.coalesce("to", "sid")))

    # Forms of the streets that are left; a form that several share settles nothing by itself.
    left = final.filter("to = sid").drop("to").withColumn("initial", F.substring("first", 1, 1))
    person = ~F.col("first").isin(*ORGANISATIONS)  # an organisation isn't called by an initial
    short = [F.when(person, F.concat_ws("|", F.lit("i"), kind, "initial", "last")) for kind in (F.col("kind"), F.lit(""))]
    forms = F.array_compact(F.array(*short, F.concat_ws("|", F.lit("f"), F.lit(""), "first", "last")))
    by_form = left.select(F.explode(forms).alias("form"), F.col("middle").alias("tmiddle"), F.col("title").alias("ttitle"), F.col("w").alias("tw"), "sid").withColumn("shared", F.count(F.lit(1)).over(W.partitionBy("form")))
    part = parsed.filter("kind = '' OR length(first) = 1")
    tag = F.when(F.length("first2") == 1, F.lit("i")).otherwise(F.lit("f"))
    asked = rewritten(part, cut(fixes_first.unionByName(called))).select("name", "middle", "title", "cost", F.concat_ws("|", tag, "kind", "first2", "last2").alias("form"))
    found = _best(asked.join(by_form, "form").withColumn("cost", F.col("cost") + F.log2("shared") / SLIP_BITS), ["name"])
    whole = full.join(final.select("kind", "first", "last", F.col("to").alias("sid")), ["kind", "first", "last"]).select("name", "sid")
    loose = part.join(found, "name", "left").select("name", F.coalesce("sid", F.concat_ws("|", F.lit("?"), "kind", "first", "middle", "last")).alias("sid"))
    return cut(whole.unionByName(loose))


def variant_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """(name_a, name_b): different spellings of one street, the smaller by code points first.

    The spellings of a street are dealt to slots, so that no task makes all pairs of a street with very many.
    """
    ids = street_ids(names, column)
    sizes = ids.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sid", F.ceil(F.col("n") / PER_SLOT).alias("slots"))
    members = cut(ids.join(sizes, "sid"))
    a = members.select(F.col("name").alias("name_a"), "sid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot"))
    b = members.select(F.col("name").alias("name_b"), "sid", F.pmod(F.xxhash64("name"), "slots").alias("slot"))
    return a.join(b, ["sid", "slot"]).filter("name_a < name_b").select("name_a", "name_b")
