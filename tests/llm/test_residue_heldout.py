"""Residue and harmless sentences written from general knowledge of web pages, logs and forms, not from the test corpus."""

from vistaframe.llm import residue as R

FOUND = [
    "JavaScript must be enabled to use this site.", "Error 503 Backend fetch failed", "Your session has timed out. Please log in.", "You need to enable JavaScript to run this app.", "This site requires JavaScript. Please turn it on and reload the page.",
    "We're sorry but the dashboard doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript is not available.", "It looks like your browser has JavaScript disabled.", "Your browser does not support JavaScript!", "For full functionality of this site it is necessary to enable JavaScript.",
    "Please enable cookies and JavaScript in your browser to continue.", "JavaScript seems to be disabled in your browser.", "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.", "Veuillez activer JavaScript pour afficher cette page.", "Por favor, active JavaScript para continuar.",
    "403 Forbidden", "404 - Page not found", "HTTP Error 500 - Internal Server Error", "502 Bad Gateway nginx/1.18.0", "504 Gateway Time-out", "The page you are looking for could not be found.", "The requested URL was not found on this server.", "Sorry, the page you requested does not exist.",
    "This site can't be reached", "This video is no longer available.", "This content is not available in your country.", "The service is temporarily unavailable. Please try again later.", "Access denied. You do not have permission to view this page.", "An unexpected error occurred. Please try again.", "Oops! Something went wrong.",
    "Unable to connect to the database.", "Error establishing a database connection", "Too many requests, please try again later.", "Your connection was interrupted. The connection has timed out.", "The server is not responding.", "Fatal error: Uncaught Error: Call to undefined function foo() in /var/www/index.php:12",
    "Exception in thread \"main\" java.lang.NullPointerException: name is null", "TypeError: Cannot read properties of undefined (reading 'map')", "Die angeforderte Seite wurde nicht gefunden.", "La page demandée est introuvable.", "La página solicitada no existe.", "Es ist ein Fehler aufgetreten.",
    "Dear {{ first_name }}, thank you for your order.", "Hello %s, welcome back!", "Total: ${amount} due on ${due_date}", "Dear [Your Name],", "Sincerely, [INSERT COMPANY NAME]", "Welcome to <%= site_name %>!", "The price is {price} euros.", "Copyright {{year}} by the authors", "Room: [TBD]", "Contact us at {email}.", "Author: XXXXX",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "This is placeholder text.", "Your text here", "Description goes here.", "Type your message here...", "Add your caption here", "asdf asdf asdf asdf", "Coming soon!", "Sample text for testing only", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque.",
    "Platzhaltertext", "Texte de remplissage", "Texto de ejemplo",
]
HARMLESS = [
    "Access denied was the reason the guard gave in the story.", "Too many requests arrived at the office on Monday.", "Connection refused to talk to the press.", "The page was torn, and the lower half of the picture is missing.", "She could not find the page she had marked the night before.", "The server brought two cups of tea to the table.",
    "We were unable to measure the height of the lamp in the second frame.", "The service was slow, but the soup was excellent.", "JavaScript was designed in ten days in 1995.", "He wrote the script for the play in two weeks.", "Scripts for the school play are handed out on Friday.", "The course teaches JavaScript and Python to beginners.",
    "An error in the survey moved the wall by two metres.", "The mean error was 0.35 with a spread of 0.02.", "About 404 chairs were counted in the hall.", "The year 503 saw a long war in the east.", "In total 502 visitors came through the gateway of the old town.", "The connection between the two rooms was closed in spring.",
    "The document was moved to the archive, where it still lies.", "The link between diet and sleep is not well understood.", "Your answer must name the object closest to the door.", "Please describe the picture in one sentence.", "Please try the other door if this one is closed.", "Sorry about the noise, said the man with the drum.",
    "The window could not be opened, because the frame was painted shut.", "The site of the old mill is no longer used.", "The request for a new desk was denied by the office in May.", "The account of the journey fills three volumes.", "He logged in the forest for twenty years.", "The post was removed from the garden fence last week.",
    "A template with the slot {name} is filled once for each object.", "The syntax {{ name }} prints the value of a variable.", "In the string literal \"%s items\" the %s is replaced by a number.", "The placeholder [caption] is explained in the manual.", "Use <b>bold</b> text for titles.", "The set {a, b, c} has three elements.",
    "The function f(x) = {x} maps onto itself.", "See note [3] for the source of this number.", "The tag <img> embeds a picture.", "Prices rose by 5 %, sales fell by 3 %.", "The old banner said \"404 Not Found\" in large letters.", "The message \"Please enable JavaScript\" confused many visitors.", "The word lorem has no meaning in English.",
    "Lorem ipsum is a text used by printers.", "No, no, no, said the child.", "The very very long table stands by the wall.", "Type A blood was found at the scene.", "Enter the room and turn left at the shelf.", "Insert the key into the lock and turn it.", "The example shows a chair next to a desk.", "A test of the alarm takes place on Monday.",
    "The sample was taken from the river bank.", "Work on the bridge is under way.", "The shop under the arcade is closed on Sundays.", "Der Server im Keller wurde im Mai ausgetauscht.", "Die Seite des Schranks ist zerkratzt.", "Die Tür konnte nicht geöffnet werden, weil der Schlüssel fehlte.", "La page du carnet est déchirée en haut à droite.", "Le service du soir commence à huit heures.",
    "La página del cuaderno está rota por arriba.", "El servicio empieza a las ocho.", "El acceso a la sala se encuentra a la izquierda.", "L'erreur de mesure est de deux centimètres.", "Der Fehler liegt bei zwei Zentimetern.", "The gateway to the park is under construction until June.", "Sign in the visitor's book at the entrance.",
]


def flagged(spark, texts):
    rows = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return {texts[r[0]] for r in R.residue(rows).collect()}


def test_recall(spark):
    got = flagged(spark, FOUND)
    missed = [t for t in FOUND if t not in got]
    assert len(FOUND) >= 60 and len(got) >= 0.9 * len(FOUND), missed


def test_precision(spark):
    got = flagged(spark, HARMLESS)
    assert len(HARMLESS) >= 60 and len(got) <= 0.05 * len(HARMLESS), got


def test_messages_that_no_list_foresees_are_found_where_they_recur(spark):
    texts = ["Please check your browser settings and reload the page.", "Redirecting you in a moment...", "Nothing to show here yet.", "Just a moment...", "No results found for your search."]
    harmless = ["The wall touches the lower edge.", "Mean depth over the lamp is 2.5 metres."]
    rows = [(10 * k + i, t, f"s{i % 2}") for k, t in enumerate(texts + harmless) for i in range(6)]
    found = {r[0] // 10 for r in R.residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == set(range(len(texts)))
    one_source = [(i, t, "s") for i, t, _ in rows]
    assert R.residue(spark.createDataFrame(one_source, "doc_id long, text string, source string")).count() == 0
    one_text = [(k, " ".join([t] * 6), f"s{k}") for k, t in enumerate(texts)]  # a text that repeats itself is one text
    assert R.residue(spark.createDataFrame(one_text, "doc_id long, text string, source string")).count() == 0
