from __future__ import annotations

import random

import pytest

from veilspark.llm import residue as rs

PARTS = ["the lease of the mill", "the notice of termination", "the second policy", "the bill of lading", "the planning consent"]
ENDS = ["was amended by conduct", "did not reach the addressee in time", "must be read with its annexes", "binds the successor in title", "left the price to be fixed later"]
HEAD = "HIGH COURT OF HOLM\nK 12/2020\nArdmoor Bank SA v. Emil T. Vetch\nDecided 3 May 2020 by Lund, presiding judge\n\n"


def ruling(seed, paragraphs=6):
    rng = random.Random(seed)
    return HEAD + "\n\n".join(f"{n}. As the lower court found, {rng.choice(PARTS)} {rng.choice(ENDS)}, and the sum of {rng.randrange(1000, 9999)} crowns fell due on {rng.randrange(1, 28)} May 2019." for n in range(1, paragraphs + 1))


REAL = ruling(5)
YES = [
    HEAD + "1. Lorem ipsum dolor sit amet, consectetur velit magna.\n2. Nibh porta lectus arcu vitae sapien quam.\n3. Reasons go here. Reasons go here.",
    HEAD + "asdf qwer foo bar xxxx\njkjk asdf zzz foo test", HEAD + "1. To be written. To be written. To be written.",
    "Home | Decisions | Search\nError 404: Not Found\nThe file behind this link could not be found.\nBack to results", "High Court of Holm\nK-1/2020\n\nPlease enable JavaScript.\nSkip to main content",
    "Die angeforderte Seite wurde nicht gefunden.\nStartseite", "La page demandée n'existe plus ou a été déplacée.", "El servicio no está disponible en este momento.", "Dies ist ein Platzhaltertext für das Layout, er wird noch ersetzt.",
    *(REAL.replace("Ardmoor", mark, 1) for mark in ("{{ PARTY NAME }}", "{claimant}", "${registry_no}", "#{judge}", "{%party_name%}", "<%= judge %>", "<<docket_no>>", "<insert claimant>", "«claimant»", "%(JUDGE)s", "%party_a%", "$docket_no$", "__AKTENZEICHEN__", "@@fecha@@", "[[respondent]]", "[INSERT JUDGE]", "[judge EINFÜGEN]", "[à compléter : docket no]", "(enter judge here)", "{0}")),
    "Court: «claimant»\nDocket: $date_of_hearing$\nDate: «reasons»",
]
NO = [
    REAL, ruling(6, 1), REAL.upper(), REAL.replace("lower", "XXXX"), REAL.replace("the lease", "█████ [...] [redacted] [name withheld]"),
    *(REAL + f"\n\n7. The form contract left the box “{q}” blank in 13 copies, and the bailiff noted as much." for q in ("{{ counsel }}", "«JUDGE»", "Lorem ipsum dolor sit amet nibh vitae.", "asdf foo bar qwer", "Before you continue, switch on\nscripts and reload the page.", "__claimant__")),
    REAL + "\n\n7. The heads {a} to {e}, set in braces by the draftsman, were read out.", REAL + "\n\n7. On that day the site answered with error 404 and the words not found, as the expert showed.", REAL.replace("2020", "[2020]"), "", "  \n", None,
    REAL + "\n\n7. Let the set {alpha} be given; the symbol $theta$ denotes the rate and %lambda% the share.", REAL + "\n\n7. The rate is $r$ and the term {n}, as the expert wrote.",
]


@pytest.fixture(scope="module")
def models():
    return rs.Models([ruling(i) for i in range(200)] + YES[3:9])


@pytest.mark.parametrize("n", range(len(YES)))
def test_residue(models, n):
    assert models.is_residue(YES[n]), (YES[n], models.coverage(YES[n]))


@pytest.mark.parametrize("n", range(len(NO)))
def test_rulings(models, n):
    assert not models.is_residue(NO[n]), NO[n]


def test_held_out_accuracy(models):
    rng = random.Random(3)
    words = rs.LOREM.split()
    right = 0
    for n in range(200):
        filler = HEAD + "\n".join(f"{i}. " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 12))).capitalize() + "." for i in range(rng.randrange(1, 7)))
        right += models.is_residue(filler) + (not models.is_residue(ruling(1000 + n, rng.randrange(1, 9))))
    assert right >= 396


#: Wording of pages and templates that stands in no seed.
UNSEEN = (
    "HTTP 502\nThe gateway got no reply from the upstream machine.\nGo to the home page", "This record could not be opened because the archive is being updated. Try again in a few minutes.", "Your browser does not allow scripts. Change this in its settings to see the ruling.",
    "Wir konnten diese Datei leider nicht laden. Bitte versuchen Sie es in einigen Minuten erneut.", "Le fichier demandé n'a pas pu être ouvert. Réessayez plus tard ou revenez à l'accueil.", "No se puede abrir el archivo solicitado. Vuelva a intentarlo dentro de unos minutos.",
    HEAD + "1. This sentence has no meaning and only shows how the page is set.\n2. Replace it with the real reasons before the template is used.", HEAD + "1. Ein Text ohne Sinn, der nur das Layout zeigt.\n2. Er wird vor der Veröffentlichung ersetzt.",
)


@pytest.mark.parametrize("n", range(len(UNSEEN)))
def test_wording_that_is_in_no_seed(models, n):
    assert models.is_residue(UNSEEN[n]), (UNSEEN[n], models.coverage(UNSEEN[n]))


def test_fields_that_are_in_no_seed(models):
    marks = ("{{%s}}", "{%s}", "${%s}", "<%%= %s %%>", "[[%s]]", "$%s$", "__%s__", "@@%s@@", "%%(%s)s")
    assert all(models.is_residue(REAL.replace("Ardmoor", mark % name, 1)) for mark in marks for name in ("tenant_name", "LANDLORD_2", "vessel.name"))


def test_model_is_a_distribution():
    import numpy as np

    p = np.exp(rs.fit(["some text here", "more of it"])).reshape(-1, 32).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)


def test_table(spark):
    rows = [(i, ruling(i), "x") for i in range(60)] + [(100, YES[0], "x"), (100, YES[0], "x"), (101, None, "x"), (102, "", "x"), (103, YES[3], "x"), (104, ruling(1, 3000), "x"), (105, ruling(1, 3000) + " {{ x_y }}", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    assert sorted(r.doc_id for r in rs.found(docs).collect()) == [100, 103, 105]
    assert rs.found(docs.where("false")).count() == 0


def test_copies_of_one_page_are_not_learned_as_prose(spark):
    pages = ["404 Not Found. The page you are looking for could not be found.", "Our register is closed. Kindly come back tomorrow; the help desk can see to it. Request id {n}."]
    for page in pages:
        rows = [(i, ruling(i, 2)) for i in range(300)] + [(1000 + i, page.replace("{n}", str(50_000 + 7 * i))) for i in range(300)]
        got = {r.doc_id for r in rs.found(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == {i for i, _ in rows if i >= 1000}, (page, len(got))


def test_prose_is_counted_over_all_distinct_texts(spark):
    texts = [ruling(i, 2) for i in range(2500)] + [ruling(1, 2)] * 50 + [YES[3], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert (rs.fitted(docs.repartition(7)).ratio == rs.Models(texts[:2500] + [YES[3]]).ratio).all()
