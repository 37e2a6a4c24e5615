"""Word lists. They must equal the reference's for right results."""

STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into through during before after this that these those it its and or but not"
).split()

TECHNICAL = "null void async await true false nil err".split()

#: Words that the stemmer leaves as they are.
UNSTEMMED = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself "
    "just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t "
    "than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with you your yours yourself yourselves"
).split()

RAKE_STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being has have had do does did will would "
    "shall should may might can could must that this these those which who whom whose what where when how why it its if then "
    "else than so as not no also each every all any both few more most other some such only same into about above after "
    "before between through during until against up down out off over under again further once using used use uses ensures "
    "ensure requires require begins begin allows allow provides provide contains contain includes include needs need makes "
    "make takes take gets get sets set just like well very"
).split()

POS_STOPWORDS = (
    "example thing way case time place point part lot number kind set list use end section note step result order line form "
    "level area side fact change group work home need world state issue problem piece"
).split()

GENERIC_HEADERS = (
    "name value type description default required example notes status key field column parameter option property attribute "
    "# no id index"
).split()

SENTENCE_VERBS = "is are was were will should must can could would has have had does do did".split()

#: Rank of a term's source; the least wins.
SOURCE_RANKS = {
    "heading": 0, "code_identifier": 1, "bold_term": 2, "structured_position": 3, "pos_extraction": 4, "corpus_abbreviation": 5,
    "dictionary": 6,
}
