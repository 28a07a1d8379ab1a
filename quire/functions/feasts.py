"""Fixed values of the church calendar: feasts, their days, their spellings, weekday and ordinal words."""

# Days from Easter Sunday.
FROM_EASTER = {
    "septuagesima": -63, "sexagesima": -56, "quinquagesima": -49, "ash wednesday": -46, "invocavit": -42, "reminiscere": -35, "oculi": -28,
    "laetare": -21, "judica": -14, "palm sunday": -7, "cena domini": -3, "good friday": -2, "easter sunday": 0, "easter monday": 1,
    "quasimodogeniti": 7, "misericordia domini": 14, "jubilate": 21, "cantate": 28, "rogate": 35, "ascension": 39, "exaudi": 42,
    "pentecost": 49, "pentecost monday": 50, "trinity": 56, "corpus christi": 60,
}

# Feasts on a day of the year (month, day).
ON_DAY = {
    "circumcision": (1, 1), "epiphany": (1, 6), "erhardi": (1, 8), "wilhelmi episcopi": (1, 10), "felicis in pincis": (1, 14),
    "sebastiani et fabiani": (1, 20), "angnetis": (1, 21), "vincencii": (1, 22), "conversionis pauli": (1, 25), "juliani episcopi": (1, 27),
    "purificacionis": (2, 2), "blasii": (2, 3), "agathe": (2, 5), "scolastice": (2, 10), "valentini": (2, 14), "kathedra petri": (2, 22),
    "mathie apostoli": (2, 24), "gregori pape": (3, 12), "benedicti": (3, 21), "annunciacionis": (3, 25), "ambrosii": (4, 4), "geori": (4, 24),
    "marci ewangeliste": (4, 25), "philippi et jacobi": (5, 1), "invencionis sancte crucis": (5, 3), "floriani": (5, 4), "urbani": (5, 25),
    "barnabe apostoli": (6, 11), "anthoni confessoris": (6, 13), "viti": (6, 15), "gervasii et prothasii": (6, 19), "x milia martyrum": (6, 22),
    "johannis baptiste": (6, 24), "johannis et pauli": (6, 26), "petri et pauli": (6, 29), "petri martyris": (6, 30), "visitacionis": (7, 2),
    "processi et martiniani": (7, 2), "udalrici": (7, 4), "kiliani": (7, 8), "translacionis benedicti": (7, 11), "margrethe": (7, 13),
    "divisio apostolorum": (7, 15), "allexi": (7, 17), "marie magdalene": (7, 22), "jacobi apostoli": (7, 25), "vincula petri": (8, 1),
    "stephani": (8, 2), "invencionis stephani": (8, 3), "translacionis valentini": (8, 4), "oswaldi regis": (8, 5), "sixti pape": (8, 6),
    "laurencii": (8, 10), "ypoliti": (8, 13), "assumpcionis": (8, 15), "bernhardi": (8, 20), "bartholomei": (8, 24), "augustini": (8, 28),
    "decollacionis johannis": (8, 29), "felicis et adaucti": (8, 30), "egidi": (9, 1), "nativitatis marie": (9, 8), "exaltacionis crucis": (9, 14),
    "lamperti": (9, 17), "mathei apostoli": (9, 21), "mauricii": (9, 22), "michahelis": (9, 29), "jeronimi": (9, 30), "francisci": (10, 4),
    "dionysii": (10, 9), "augustini episcopi": (10, 11), "cholmanni": (10, 13), "galli abbatis": (10, 16), "luce ewangeliste": (10, 18),
    "xi milium virginum": (10, 21), "simonis et jude": (10, 28), "omnium sanctorum": (11, 1), "animarum": (11, 2), "leonhardi": (11, 6),
    "martini": (11, 11), "briccii": (11, 13), "emundi episcopi": (11, 16), "elisabet": (11, 19), "cecilie": (11, 22), "clementis": (11, 23),
    "katherine": (11, 25), "andree apostoli": (11, 30), "nicolai": (12, 6), "concepcionis": (12, 8), "lucie": (12, 13), "thome apostoli": (12, 21),
    "christmas": (12, 25), "stephani protomartyris": (12, 26), "johannis apostoli": (12, 27), "innocentum": (12, 28), "silvestri": (12, 31),
}

# Advent Sundays, counted from 0.
ADVENT = {"first advent": 0, "second advent": 1, "third advent": 2, "fourth advent": 3}

# Feasts whose names are also those of persons (or plain words) where no date word stands by them.
ALSO_NAMES = {
    "geori", "martini", "leonhardi", "andree apostoli", "erhardi", "wilhelmi episcopi", "michahelis", "johannis baptiste", "johannis apostoli",
    "elisabet", "valentini", "augustini", "bernhardi", "viti", "lamperti", "thome apostoli", "anthoni confessoris", "marci ewangeliste",
    "mathei apostoli", "gregori pape", "benedicti", "misericordia domini", "cena domini", "stephani",
}

# Feasts whose day is in doubt.
DOUBTFUL = {"petri martyris", "sixti pape", "translacionis valentini"}

_EVANGELIST = r"e[wv]ang(?:e)?liste\.?"
_STEPHEN = r"ste(?:ph|pf|pff|ppf|pph|ff)ani"

# Spellings of feasts, the more telling before the shorter ones that would match as well.
SPELLINGS = [
    ("quasimodogeniti", r"quasi\s*modo\s*geniti"),
    ("misericordia domini", r"miser[i]?c[o]?rdia(?:\s+domini)?"),
    ("rogate", r"vocem\s+iocunditatis|rogacionum"),
    ("septuagesima", r"lxx\s*me\b|septuagesim(?:a[m]?|e)"),
    ("sexagesima", r"lx\s*me\b|sexagesim(?:a[m]?|e)|exurge"),
    ("quinquagesima", r"\bl\s*me\b|quinquagesim(?:a[m]?|e)|esto\s+mic?hi|festo\s+micha"),
    ("invocavit", r"invocavit"),
    ("reminiscere", r"reminiscere"),
    ("oculi", r"oculi"),
    ("laetare", r"l[ae]tare"),
    ("judica", r"[ji]udica"),
    ("jubilate", r"[ji]ubilate"),
    ("cantate", r"cantate"),
    ("exaudi", r"exaudi"),
    ("palm sunday", r"palmarum"),
    ("cena domini", r"cen[ae][m]?(?:\s+domini)?"),
    ("good friday", r"parasc(?:h)?[ae](?:ph|v)e[sn]?"),
    ("ash wednesday", r"c[iy]nerum"),
    ("ascension", r"ascen[sc]+ion(?:is|em)(?:\s+domini)?"),
    ("pentecost", r"pe?n?t[h]?ecoste[sn]?"),
    ("corpus christi", r"corporis\s+christi"),
    ("trinity", r"trinitatis"),
    ("easter sunday", r"pasc[h]?(?:ae|e|a)"),
    ("first advent", r"dominica\s+(?:(?:prima|1a)\s+)?adventus(?:\s+domini)?"),
    ("second advent", r"dominica\s+(?:secunda|2a)\s+adventus(?:\s+domini)?"),
    ("third advent", r"dominica\s+(?:tertia|tercia|3a)\s+adventus(?:\s+domini)?|dominica\s+gaudete"),
    ("fourth advent", r"dominica\s+(?:quarta|4a)\s+adventus(?:\s+domini)?|dominica\s+rorate"),
    ("invencionis stephani", rf"inven(?:t|c)ion(?:em|is|e)\s+(?:sancti\s+)?{_STEPHEN}(?:\s+in\s+patavia)?|{_STEPHEN}\s+inven(?:t|c)ion(?:em|is|e)"),
    ("stephani protomartyris", rf"{_STEPHEN}\s+protomartyris"),
    ("stephani", rf"(?:sancti\s+)?(?:{_STEPHEN}(?:\s+(?:in\s+patavia|patavie))?|stef\b\.?)"),
    ("invencionis sancte crucis", r"invencion(?:is|em)\s+sancte\s+crucis"),
    ("exaltacionis crucis", r"exaltacion(?:is|em)\s+(?:sanct[ei]\s+)?crucis|angaria[m]?\s+crucis"),
    ("nativitatis marie", r"nativitatis\s+(?:beate\s+)?(?:vir?ginis(?:\s+gloriose)?|marie(?:\s+vir?ginis)?(?:\s+gloriose)?)"),
    ("annunciacionis", r"annun[cti]{1,4}a?c?ionis\s+(?:vir?ginis\s+gloriose|marie(?:\s+vir?ginis)?(?:\s+gloriose)?)|annuntiatio(?:nem)?\s+beatae?\s+maria[e]?\s+vir?ginis"),
    ("visitacionis", r"visitacionis(?:\s+(?:vir?ginis\s+gloriose|marie))?"),
    ("purificacionis", r"purificacionis(?:\s+(?:vir?ginis\s+gloriose|marie(?:\s+vir?ginis)?))?|liecht?messe?"),
    ("concepcionis", r"concepcionis(?:\s+vir?ginis)?(?:\s+marie)?(?:\s+gloriose)?"),
    ("assumpcionis", r"assumpcion(?:is|em)(?:\s+(?:vir?ginis\s+gloriose|marie(?:\s+vir?ginis)?))?"),
    ("johannis baptiste", r"nativitatis\s+(?:sancti\s+)?johannis\s+[wb]aptiste"),
    ("christmas", r"nat(?:alis|ivitatis)\s+(?:christi|domini)|nativitatis|weihnacht\w*|christtag"),
    ("epiphany", r"ep[iy]p[p]?[hf]ani(?:a|e)[ms]?(?:\s+domini)?"),
    ("circumcision", r"circumcision(?:is|em)(?:\s+domini)?"),
    ("omnium sanctorum", r"omnium\s+sanctorum|aller\s*heyligen\s*tag\w*"),
    ("animarum", r"animarum|aller\s*seelen\s*tag\w*"),
    ("petri et pauli", r"(?:beatorum\s+)?(?:apostolorum\s+)?petri\s+et\s+pauli(?:\s+apostolorum)?"),
    ("decollacionis johannis", r"deco[l]{1,2}a(?:c|t)ion(?:is|em)\s+(?:sancti\s+)?johannis\s+[wb]aptiste"),
    ("johannis et pauli", r"(?:beatorum\s+martyrum\s+)?johannis\s+et\s+pauli(?:\s+martyr(?:um|is))?"),
    ("johannis baptiste", r"(?:sancti\s+)?johannis\s+[wb]aptiste"),
    ("johannis apostoli", rf"(?:sancti\s+)?johannis\s+(?:apostoli(?:\s+et\s+{_EVANGELIST})?|{_EVANGELIST})"),
    ("kathedra petri", r"kathedr[ae]\s+(?:sancti\s+)?petri"),
    ("vincula petri", r"vincula\s+(?:sancti\s+)?petri(?:\s+apostoli)?"),
    ("petri martyris", r"petri\s+martyris"),
    ("conversionis pauli", r"conversion(?:is|em)\s+(?:sancti\s+)?pauli"),
    ("translacionis benedicti", r"translacion(?:is|e|em)\s+sancti\s+benedicti(?:\s+abbat[t]?is)?"),
    ("divisio apostolorum", r"divisio(?:nis)?\s+apostolorum"),
    ("xi milium virginum", r"(?:xi\s*cim|xim|xi|undecim)\s+(?:milium\s+)?virginum"),
    ("x milia martyrum", r"(?:x|decem)\s+mili(?:um|a|e)[m]?\s+martyrum"),
    ("augustini episcopi", r"augustini\s+episcopi"),
    ("augustini", r"(?:sancti\s+)?augustini"),
    ("michahelis", r"(?:sancti\s+)?michah?el(?:is|em)|michahel\.|michelstag"),
    ("martini", r"(?:sancti\s+)?martini(?:\s+episcopi)?|martinstag"),
    ("leonhardi", r"(?:sancti\s+)?l(?:eo|i)n[h]?ard[io](?:\s+confessoris)?"),
    ("bernhardi", r"(?:sanctissimi\s+patris\s+nostri\s+)?(?:sancti\s+)?bernhardi(?:\s+abbat[t]?is)?"),
    ("bartholomei", r"(?:sancti\s+)?[wb]artholomei(?:\s+apostoli)?"),
    ("andree apostoli", r"(?:sancti\s+)?andre[e]?(?:\s+apostoli)?(?:\s+(?:in\s+patavia|patavie))?"),
    ("thome apostoli", r"(?:sancti\s+)?thome(?:\s+apostoli)?"),
    ("jacobi apostoli", r"(?:sancti\s+)?jacobi(?:\s+apostoli)?(?:\s+in\s+partibus\s+inferioribus)?"),
    ("philippi et jacobi", r"philippi\s+et\s+jacobi(?:\s+apostolorum)?"),
    ("mathie apostoli", r"(?:sancti\s+)?mathie\s+apostoli"),
    ("mathei apostoli", rf"(?:sancti\s+)?mathei(?:\s+(?:apostoli|{_EVANGELIST})(?:\s+et\s+{_EVANGELIST})?)?"),
    ("marci ewangeliste", rf"marci(?:\s+{_EVANGELIST})?"),
    ("luce ewangeliste", rf"luce\s+{_EVANGELIST}"),
    ("marie magdalene", r"marie\s+magdalene"),
    ("katherine", r"(?:sancte\s+)?kath(?:e|a)rine(?:\s+vir?ginis)?"),
    ("margrethe", r"marg[ae]?ret[h]?e(?:\s+vir?ginis)?"),
    ("cecilie", r"cecilie(?:\s+vir?ginis)?"),
    ("lucie", r"(?:angaria[m]?\s+)?lucie(?:\s+vir?ginis)?"),
    ("angnetis", r"a[n]?gnetis(?:\s+vir?ginis)?"),
    ("agathe", r"agat[h]?e(?:\s+vir?ginis)?(?:\s+martyris)?"),
    ("scolastice", r"sc[h]?olastic(?:ae|e)(?:\s+vir?ginis)?"),
    ("elisabet", r"eli[sz]abet[h]?"),
    ("innocentum", r"innocentum|kindlein\w*tag\w*"),
    ("laurencii", r"(?:sancti\s+)?laurencii(?:\s+martyris)?"),
    ("vincencii", r"(?:beati\s+|sancti\s+)?vincencii(?:\s+mart[yi]ris)?"),
    ("clementis", r"clementis(?:\s+pape\s+et)?\s+martyris"),
    ("lamperti", r"lamperti(?:\s+(?:martyris|episcopi(?:\s+et\s+(?:martyris|confessoris))?))?"),
    ("viti", r"\bviti(?:\s+martyris)?"),
    ("ypoliti", r"ypoliti(?:\s+martyr(?:um|is))?"),
    ("blasii", r"blasii(?:\s+episcopi)?"),
    ("nicolai", r"(?:sancti\s+)?nicolai(?:\s+episcopi)?"),
    ("erhardi", r"erhardi(?:\s+episcopi)?"),
    ("juliani episcopi", r"juliani\s+episcopi"),
    ("wilhelmi episcopi", r"wilhelmi\s+episcopi(?:\s+et\s+confessoris)?"),
    ("briccii", r"briccii(?:\s+episcopi)?"),
    ("ambrosii", r"ambrosii(?:\s+episcopi)?(?:\s+confessoris)?"),
    ("emundi episcopi", r"(?:ae|e)(?:d)?mundi(?:\s+episcopi)?"),
    ("udalrici", r"[uv](?:da)?lrici(?:\s+episcopi)?"),
    ("mauricii", r"(?:sancti\s+)?maurici[i]?(?:\s+et\s+sociorum\s+eius)?"),
    ("jeronimi", r"jeronimi(?:\s+confessoris)?"),
    ("gregori pape", r"gregori[i]?(?:\s+pape)?"),
    ("gervasii et prothasii", r"gervasii\s+et\s+p(?:ro|or)t[h]?asii"),
    ("floriani", r"floriani(?:\s+mart[yi]ris)?"),
    ("benedicti", r"(?:sancti\s+)?benedicti(?:\s+abbat[t]?is)?"),
    ("sixti pape", r"\bsixti(?:\s+pape)?"),
    ("francisci", r"francisci(?:\s+confessoris)?"),
    ("dionysii", r"d[iy]on[iy]si[i]?"),
    ("simonis et jude", r"s[iy]monis\s+et\s+[ji]ude(?:\s+apostolorum)?"),
    ("sebastiani et fabiani", r"(?:sebastiani\s+et\s+fabiani|fabiani\s+et\s+sebastiani)(?:\s+mart[yi]rum)?"),
    ("felicis in pincis", r"felicis\s+in\s+pincis"),
    ("felicis et adaucti", r"felicis\s+et\s+(?:ad\s+)?(?:ad)?aucti(?:\s+mart[yi]rum)?"),
    ("oswaldi regis", r"oswaldi\s+regis(?:\s+et\s+mart[yi]ris)?"),
    ("kiliani", r"kiliani"),
    ("egidi", r"egidi[i]?(?:\s+abbat[t]?is)?"),
    ("barnabe apostoli", r"[wb]arnabe(?:\s+apostoli)?"),
    ("galli abbatis", r"galli(?:\s+abbatis)?"),
    ("cholmanni", r"(?:solucionis\s+)?cholmanni|colmani"),
    ("processi et martiniani", r"processi\s+et\s+martiniani"),
    ("anthoni confessoris", r"(?:sancti\s+)?anthoni(?:\s+confessoris)?"),
    ("allexi", r"al[l]?exi[i]?"),
    ("translacionis valentini", r"translacion(?:is|e|em)\s+(?:sancti\s+)?valentini(?:\s+(?:in\s+patavia|patavie))?"),
    ("valentini", r"valentini(?:\s+mart[yi]ris)?"),
    ("urbani", r"(?:beati\s+)?[uv]rbani"),
    ("geori", r"(?:sancti\s+)?geori[i]?(?:\s+mart[yi]ris)?"),
    ("silvestri", r"silvestri"),
]

# The number of a weekday (Monday 1 to Saturday 6) by its word, digit or numeral.
FERIA_NUMBERS = {
    "secunda": 1, "2": 1, "2a": 1, "2da": 1, "ii": 1, "iia": 1, "iida": 1,
    "tertia": 2, "tercia": 2, "3": 2, "3a": 2, "3cia": 2, "3tia": 2, "iii": 2, "iiia": 2, "iiicia": 2, "iiitia": 2,
    "quarta": 3, "4": 3, "4a": 3, "4ta": 3, "iiii": 3, "iiiia": 3, "iiiita": 3, "iv": 3, "iva": 3, "ivta": 3,
    "quinta": 4, "5": 4, "5a": 4, "5ta": 4, "v": 4, "va": 4, "vta": 4,
    "sexta": 5, "6": 5, "6a": 5, "6ta": 5, "vi": 5, "via": 5, "vita": 5,
    "septima": 6, "7": 6, "7a": 6, "7ma": 6, "vii": 6, "viia": 6, "viita": 6,
}
# Days with a name of their own (Saturday 6, Sunday 7).
DAY_NAMES = {
    "sabbato": 6, "sabbatho": 6,
    "dominica": 7, "dominicam": 7, "domica": 7, "domicam": 7,
}
# Which Sunday, or other weekday, after or before a feast.
COUNTS = {
    "prima": 1, "1": 1, "1a": 1, "i": 1, "ia": 1,
    "secunda": 2, "2": 2, "2a": 2, "ii": 2, "iia": 2,
    "tertia": 3, "tercia": 3, "3": 3, "3a": 3, "iii": 3, "iiia": 3,
    "quarta": 4, "4": 4, "4a": 4, "iiii": 4, "iiiia": 4, "iv": 4, "iva": 4,
}
# Endings of ordinals on year numerals, shortest first.
YEAR_ENDINGS = ("", "o", "mo", "to", "no", "do", "vo", "io", "mi", "ti", "ni", "di", "cio", "tio", "cii", "tii")
