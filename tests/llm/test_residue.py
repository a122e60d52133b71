import os

import pytest

from coursegrain.llm import residue as module
from coursegrain.llm.residue import Models, counted, fit, residue

FOLDER = os.environ.get("COURSEGRAIN_CORPUS", "/root/testdata/sf0.01")
PROSE = ["The pump moves the water because the valve opens the pipe.", "Students compare the lens with the mirror of the long tube.", "Each cell has a wall, a core and a store of salt.", "When the river is cold, the wheel turns again."]
BAD = [
    "Welcome to {{course_title}}, taught by [INSTRUCTOR NAME].", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "404 - The page you asked for was not found.", "Please enable JavaScript to view this page.",
    "Click to add title\nClick to add text", "Error 503: the service is temporarily unavailable.", " ".join(PROSE) + " Contact [INSERT OFFICE HOURS HERE] soon. " + " ".join(PROSE),
]
GOOD = PROSE + [" ".join(PROSE * 50), 'The error message "access denied" appears when the reader lacks a permission bit, as the table shows.', "In a template engine, a placeholder such as {{name}} is replaced by a value before the page is sent.", "The ____ moves the water. (fill in the blank)"]
#: Held out: none of these stands in the examples that the models are fitted on.
RESIDUE = """Dear <FirstName>, your order is ready.
Unable to load content. Tap to retry.
Hello [Recipient], thanks for joining.
Hi {{firstName}}, your trial ends on {{trial_end}}.
The meeting takes place in [ROOM] at [TIME].
This agreement is made between {PARTY_A} and {PARTY_B}.
Yours sincerely, [Your Name Here]
Price: $AMOUNT$ per month
Lecture by <speaker>, Department of <department>.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque.
Nunc tincidunt, elit non cursus euismod, lacus augue ornare metus, egestas imperdiet nulla nisl quis mauris.
Tap here to write your introduction
Your headline goes here. Your story goes here.
Click to insert a picture
This block is a placeholder for the real text.
asdf asdf asdf jkl jkl
We could not find the page that you wanted. Please go back and try another link.
HTTP 503 - the upload service is down. Please retry in a minute.
An internal error occurred. Our team has been told.
You are not allowed to see this folder. Ask its owner for access.
Your login has expired. Please sign in once more.
This video is not available in your country.
The connection to the database was lost. Error code 2013.
Internal fault in the server, please send the form once more.
Sorry, this file is no longer available.
Whoops, that did not work. Reload and try again.
No se encuentra la página solicitada. Intente más tarde.
Die angeforderte Seite existiert nicht. Bitte versuchen Sie es später.
JavaScript seems to be disabled in your browser. Enable it for the best experience.
You must turn on JavaScript before you can take this quiz.
This web app needs a browser with scripting switched on.
Please allow scripts and reload this lesson.
Scripts are blocked here, so the slides cannot be drawn.
Por favor, active JavaScript para usar esta página.""".split("\n")
NO_RESIDUE = """You do not have permission to enter the reactor hall without a badge.
The valve was not found in the second box, so the students looked in the third.
An error in the measurement grows with the distance from the sensor.
The service of the library is available on weekdays.
The page of the ledger was torn, and the clerk copied it by hand.
Students request a document at the office and sign for it.
The connection between the two pumps was lost in the storm.
A browser asks a server for a page and shows what comes back.
JavaScript was written in ten days and is now the language of the web.
The scripts of the play were printed in 1623.
A server that cannot find a page answers with the code 404.
Cicero wrote about pain and pleasure; printers took his words as filler.
In mail merge, a field such as <<Name>> is replaced by the name of each person.
In a set {a, b, c} the order of the items does not matter.
The array a[i] holds the value that the loop has just read.
The pump moves the water because the valve opens the pipe.
El guion de la obra fue escrito en Madrid y se representa cada verano.
Der Fehler liegt in der zweiten Messung, wie die Tabelle zeigt.
La page du livre montre une carte de la ville et de ses ponts.
Ang guro ay nagpakita ng isang mapa ng lungsod sa mga mag-aaral.
The ____ carries blood to the heart. (fill in the blank)
Complete the sentence: water boils at ____ degrees.
Try the experiment again with a longer wire and compare the results.
Contact between the plates must be avoided, or the fuse blows.
The session of the council ended at noon and the members went home.
The title of the painting is unknown, but its author lived in Ghent.
Add the acid to the water, never the water to the acid.
Enter the value in the first column and the unit in the second.
Click reactions join two molecules quickly and with few side products.
The text was written on clay, and most of it can still be read.
A null value stands for something that is not known.
The request of the king was refused by the parliament in 1641.
Reload times of early cannons were measured in minutes.
The gateway of the fort was closed at night.""".split("\n")


def models(texts):
    return Models(counted(texts))


def covered(m, texts):
    return [c for c, _ in m.judged(texts)]


def test_texts_and_their_company():
    m = models(PROSE * 40)
    assert [t for t, c in zip(BAD, covered(m, BAD)) if c < 8] == []
    assert [t for t, c in zip(GOOD, covered(m, GOOD)) if c >= 8] == []
    assert m.judged([""]) == [(0, None)] and m.judged([]) == [] and max(covered(m, ["", "x", ""])) < 8
    # what stands beside a text changes nothing
    mixed = BAD + GOOD + ["", "x", "404"]
    assert m.judged(mixed) == [m.judged([t])[0] for t in mixed]


def test_held_out_lists():
    fitted = "\n".join(module.placeholders() + module.filler() + module.errors() + module.scripts() + module.NATURAL)
    assert not [t for t in RESIDUE + NO_RESIDUE if t in fitted]
    m = models(PROSE * 40 + [t for t in NO_RESIDUE if "pump" in t])
    found = [c >= 8 for c in covered(m, RESIDUE)]
    assert sum(found) >= 0.9 * len(found)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_held_out_lists_beside_a_corpus(spark):
    m = fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    found, false = [c >= 8 for c in covered(m, RESIDUE)], [c >= 8 for c in covered(m, NO_RESIDUE)]
    assert sum(found) >= 0.9 * len(found) and sum(false) < 0.05 * len(false)


def test_corpus_size_changes_nothing():
    texts = PROSE * 5 + BAD + GOOD
    one, ten = models(texts * 40), models(texts * 400)
    assert [k for _, k in one.judged(texts)] == [k for _, k in ten.judged(texts)]


def test_rows(spark):
    rows = [(k, t, 1) for k, t in enumerate(BAD + GOOD)] + [(900, None, 1), (901, "", 1), (902, " \n\n", 1), (903, "x", 1), (2, BAD[2], 1)] + [(1000 + k, t, 1) for k, t in enumerate(PROSE * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = residue(df).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(BAD)), 2])
    assert {r.kind for r in got} == {"placeholder", "filler", "error", "scripts"}
    assert residue(df.limit(0)).count() == 0


def test_all_documents_are_counted_in_full(spark):
    texts = [" ".join(PROSE * 30) + " Jupiter quickly vexed five zephyrs by the way.", None, "", "x"] + PROSE * 25
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert (fit(df).natural == models([t for t in texts if t]).natural).all()
