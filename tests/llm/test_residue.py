import pytest
from pyspark.sql import functions as F

from siftmill.llm import residue as R

SOUND = "Samples were incubated at 20 °C for 4 h before analysis. The effect (p = 0.04) was 12% in both arms."


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ author }}, your record was moved.", "In {% block title %} districts", "kept ${country} records", "the %(year)s logbook", "<%= summary %> studies", "separate <<year>> exercise", "&lt;abstract&gt; array",
        "<your title here> studies", "[INSERT COUNTRY] records", "We found [JOURNAL HERE] records", "[summary to be added] districts", "two [[year]] reviewers", "highest __SUMMARY__ in", "Dear undefined, the paper undefined was moved to [object Object].",
        "The study enrolled NaN participants between null and null.", "A total of XX adults were followed and YY% responded (p = 0.XXX).", "TODO: add the results for age.", "TBD TBD.", "This is placeholder text for the methods section.",
        "Type the abstract here.", "Your results goes here.", "Click to edit.", "Lorem ipsum dolor sit amet velit nulla.", "xxxx xxxx xxxx xxxx", "Please enable JavaScript to view this page.", "This site requires cookies and scripts. Turn them on in your browser settings and reload.",
        "404 Not Found", "Internal server error. Request ID: 3fa2", "The paper you requested is not on this server.", "Erreur 404 : la page demandée est introuvable.", "Veuillez activer JavaScript pour afficher cet article.", "Your session has expired. Please sign in again to read the full text.",
        "Gateway timeout while fetching the abstract.", "Too many requests from this network. Wait 30 seconds and reload the page.", "Sorry, this file could not be displayed.", "Without scripts the full text stays blank.",
    ],
)
def test_residue(text):
    assert R.examine(text)[0] and R.examine(f"{SOUND} {text}\n{SOUND}")[0]


@pytest.mark.parametrize(
    "text",
    [
        None, "", SOUND, "Participants saw the notice “page not found” in 3% of trials.", "Pages that returned error 404 were excluded from the sample of 12 clinic sites.", "Sites that required JavaScript were rendered in a headless browser before coding.",
        "Access was denied to 12 clinics, whose records stay missing.", "Filler text such as lorem ipsum was shown to readers in the control condition.", "Nurses had to enable cookies before the sensor array could load; 5% failed to do so.",
        "Undefined values and null results were both recorded by two independent reviewers.", "Server errors (code 503) made up 5% of all logged incidents in four border counties.", "Placeholder tablets were used as the control for peer feedback.",
        "Open TODO comments per thousand lines predicted defect density.", "The template engine replaced each {name} slot with the name of the pupil, as intended.", "The variable abstract_3 was renamed in 12 scripts during the refactoring.",
        "Respondents wrote “[sic]” or [n = 12] in the margin.", "Cost was $12 per assay and ${\\beta}$ was fixed at 0.5.", '{"decision": "include", "confidence": 0.9, "evidence_span": "{x} was used"}', "Interview transcripts and hospital files point to a server room.", "Missing values were handled by high-content imaging.",
        "It is 50% {a, b} of the set [1, 2] in <0.05 and >0.01.",
    ],
)
def test_sound(text):
    assert R.examine(text)[0] == []


def test_copied_notices_of_a_host(spark):
    # wording alone leaves this line open; that it stands in many unrelated texts settles it
    line = "Instructions are on the help page."
    assert R.examine(line)[0] == [] and R.examine(line)[1]
    rows = [(i, f"{SOUND}\n{line}" if i < 5 else SOUND, "feed", 1) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kinds int")
    assert {r["doc_id"] for r in R.residue(df, "doc_id", "text", ["source"]).collect()} == set(range(5))
    assert R.residue(df.filter("doc_id in (0, 6, 7)"), "doc_id", "text", ["source"]).count() == 0


def test_frames(spark):
    rows = [(1, "Page not found.", None), (1, "Page not found.", None), (2, None, "s"), (3, "", "s"), (4, SOUND * 5_000, "s"), (None, "{{x}}", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("r", F.lit(1)).withColumn("h", F.lit(2))
    assert {r["doc_id"] for r in R.residue(df, "doc_id", "text", ["source"]).collect()} == {1, None}
    assert R.residue(df.limit(0), "doc_id", "text", ["source"]).count() == 0


@pytest.mark.parametrize(
    "text",
    ["Dear $journal$, your record was moved.", "This review of «country» included «summary» studies.", "studies from #{section_2}.", "We found {outcome} records", "None (None). Name None, None: None.", "Fig. ?? shows the outcome; see Section ?? and [CITATION NEEDED FROM AUTHOR].", 'File "render.py", line 12, in show', "We could not load this article.", "This reader relies on JS. Activate it to open the document.", "If nothing happens, check that script blocking is off.", "scripts must be switched on to read this record", "~name~ and ~country~ of the study"],
)
def test_other_residue(text):
    assert R.examine(text)[0] and R.examine(f"{SOUND} {text}")[0]


@pytest.mark.parametrize("text", ["Let the set {x_3, x_4} denote the classes.", "Sessions that expired before the last item were treated as incomplete.", "None of the 12 records was lost.", "Is it so?? Nobody knows.", "The $p$ value and the @mentions of [Figure 2] were counted.", "A <b>bold</b> claim."])
def test_other_sound(text):
    assert R.examine(text)[0] == []


def alternatives(items):
    """Texts that a parsed pattern matches, one or more for each of its alternatives."""
    C = R.C
    found = [""]
    for op, av in items:
        if op == C.LITERAL:
            each = [chr(av)]
        elif op == C.IN:
            sets = {C.CATEGORY_DIGIT: "7", C.CATEGORY_WORD: "a", C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_WORD: "."}
            each = ["a"] if av[0][0] == C.NEGATE else [chr(x) if o == C.LITERAL else chr(x[0]) if o == C.RANGE else sets[x] for o, x in (av if len(av) < 5 else [av[0], av[-1]])]
        elif op == C.SUBPATTERN:
            each = alternatives(av[3])
        elif op == C.BRANCH:
            each = [x for branch in av[1] for x in alternatives(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            each = [x * max(av[0], 1) for x in alternatives(av[2])] + [""] * (av[0] == 0)
        else:
            each = [""]
        wide, narrow = max(found, each, key=len), min(found, each, key=len)
        if len(wide) * len(narrow) > 400:  # every part once instead of every combination
            found = [found[i % len(found)] + each[i % len(each)] for i in range(max(len(found), len(each)))]
        else:
            found = [a + b for a in found for b in each]
    return found


@pytest.mark.parametrize("pattern", [p for _, p in R.SLOTS] + [R.FILLER, R.REPEATED] + [p for _, p in R.NOTICE])
def test_gates_pass_what_patterns_match(pattern):
    texts = [t for x in alternatives(R._parser.parse(pattern.pattern, pattern.flags)) for t in (x, x.upper(), x.replace("i", "\u0130").replace("s", "\u017f")) if pattern.search(t)]
    assert texts
    for t in texts:
        assert R.possible(R.fold(t), [len(t)])[0] & R.pattern_bits().of(pattern), t
        for whole in (t, f"{SOUND} {t}", f"{t}\nPlease go on."):
            assert R.examine(whole) == R.examine(whole, gated=False)


LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)


@pytest.mark.parametrize(
    "text",
    [*R.segments(LOREM), "503 Service Unavailable", "Service Temporarily Unavailable", "This article is not available to you.", "Please wait while we verify that you are human.", "test test test test test test", "Sample abstract text.", "We are sorry, but we could not load the article that you asked for at this moment, " + "because the connection between this reader and the archive that holds it was lost while the page was being put together, " * 2 + "so please check your network and reload this page.", "To be completed.", "To be written.", "Text to follow.", "Tap to edit."],
)
def test_nothing_is_dropped_unseen(text):
    assert R.examine(text)[0] and R.examine(f"{SOUND} {text}")[0]


@pytest.mark.parametrize("text", ["Patients (type 2 diabetes) were enrolled.", "These data do not support road salt as a remedy. Limitations should be noted: cost data were unavailable.", "Earlier reports described an early link between walking and pressure, but cost data were unavailable."])
def test_sound_without_gates(text):
    assert R.examine(text)[0] == []


BODIES = ["Lichens grew on old walls. Lichens covered old walls in the north.", "Tides moved the sand. The sand of all tides was weighed.", "Bees visited clover. Clover and bees were counted.", "Rivers froze early. Early ice on rivers was thin."]


def found(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    return {r["doc_id"] for r in R.residue(df, "doc_id", "text", ["source"]).collect()}


def test_unlisted_wording_is_judged_by_its_copies(spark):
    line = "Verify you are human. Complete the check below to continue to papers.example.org."
    assert R.examine(line)[0] == []
    assert found(spark, [(line, "a"), (f"{line}\n\n{BODIES[0]}", "b"), (BODIES[1], "b")]) == {0, 1}
    assert found(spark, [(line, "a"), (BODIES[0], "b"), (BODIES[1], "b")]) == set()


@pytest.mark.parametrize("line", ["Materials and further methods", "Filler text such as lorem ipsum was shown to readers in the control condition.", "Sites that required JavaScript were rendered in a headless browser before coding."])
def test_copies_without_the_wording_of_a_notice_are_sound(spark, line):
    assert found(spark, [(line, "a"), *((f"{line}\n{b}", "b") for b in BODIES)]) == set()


def test_terms_are_learned_from_what_wording_settles(spark):
    known = ["No record matches this link. Please reload the page.", "This page is not available. Please check the link and reload the page.", "Please reload the page or check the link of this record."]
    rows = [(k, "a") for k in known] + [(b, "b") for b in BODIES * 3]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    notices = spark.createDataFrame([(R.skeleton(R.fold(s)),) for k in known for s in R.segments(k)], "notice string")
    texts = df.select("text").mapInArrow(R._count, "at int, n bigint")
    terms = R.train_terms(notices, texts)
    odds = terms.of(R.words_of("please reload this page.\ntides moved the sand"))
    assert odds[0] > R.TERMS_LEAST > 0 > odds[1]
    assert R.weigh("Check the link and reload the page.", "", terms) and not R.weigh("Pages were reloaded and links checked.", "", terms)
    for text in ("One. Two?” Three\n\n– \nfour 5.6 e.g. six", "", "...", "a.b (c.) d.\n"):
        assert len(terms.of(R.words_of(text))) == len([s for s in R.segments(text) if R.re.search(r"[^\W_]", s)])
    assert R.train_terms(notices.limit(0), texts) is None


def test_words_of_texts():
    one = R.words_of("two ends two. ends 12 ends 7\nxxtwo two7ends 𝒳")
    assert one.one[0] == one.one[2] == one.one[8] != one.one[1] == one.one[3] == one.one[5] == one.one[10] and one.one[4] == one.one[6] == one.one[9] and one.one[7] != one.one[0]
    assert one.two[0] != one.two[1] and one.two[1] != one.two[3] and R.words_of("ends two").two[0] == one.two[1]
    assert one.inside.tolist() == [i not in (2, 6, len(one.one) - 1) for i in range(len(one.one))]


def test_copies_within_one_host(spark):
    line = "Use the search box instead."
    # elsewhere the line belongs to its texts; the host that puts it into strange ones is known by itself
    own = f"{line} Readers had a search box and used the search box instead of lists."
    assert found(spark, [*((f"{b} {line}", "a") for b in BODIES[:3]), *((own, "b") for _ in range(4))]) == {0, 1, 2}


def test_shared_sentences_are_sound(spark):
    line = "Walls and sand, clover and rivers were compared."
    assert found(spark, [*((f"{b} {line}", "a") for b in BODIES)]) == set()
