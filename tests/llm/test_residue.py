"""Problem 1: leftovers against articles that only mention them."""

from feedmill.llm.residue import find_leftovers, is_leftover, keep_articles, weigh

PROSE = "The harbour board signed the new quay near Tolmby, but the union has not said whether it will accept the plan. A pension fund is expected to pay for the depot, because the city council declined."
LEFTOVERS = [
    "{{ headline }}\n{{ body }} null\n{{city}}",
    "{% block lede %}{% endblock %}\n{% block body %}{% endblock %}: undefined",
    "<%= title %> – <%= tags %>",
    "By ${author}\n${summary}",
    "[[title]]\nBy <<company>>\n*|CITY|*\n%%quote%%\n#body#\n$lede$\n__date__\n[INSERT HEADLINE HERE]",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed eiusmod tempor.",
    "xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx",
    "Please enable JavaScript to continue.",
    "• Home\n• News\n• Sport\n• About us\nPage not found. The address may have changed.\n© 2024 Tolmby Post. All rights reserved.",
    "404\nSeite nicht gefunden. Der Artikel wurde möglicherweise gelöscht.",
    'Traceback (most recent call last):\n  File "/srv/app/render_12.py", line 80, in view\nKeyError: \'company\'',
    '{"status": 500, "message": "upstream failed", "id": "8ab1"}',
    "<Error><Code>NoSuchItem</Code><Key>7f0b</Key></Error>",
    "undefined\nNaN\n[object Object]",
]
ARTICLES = [
    PROSE,
    PROSE + "\n{{ad_slot_2}}\n" + PROSE,
    "Developers in Tolmby were told to write {{ total }} in the invoice template, and 808 clients noticed. " + PROSE,
    "“Page not found” was all that 825 customers of the utility could read during the outage. " + PROSE,
    "How to write a template:\n```\n{{ title }}\n{{ body }}\n<%= city %>\n```\n" + PROSE,
    "The library now teaches children why JavaScript must be enabled for 483 of its exhibits. " + PROSE,
    "The dairy cooperative took over the sensor network.",
    "Short note",
    "",
    "   \n ",
    None,
]


def test_decisions():
    assert [t for t in LEFTOVERS if not is_leftover(t)] == []
    assert [t for t in ARTICLES if is_leftover(t)] == []
    assert is_leftover("\n".join(LEFTOVERS[:1] * 20_000))
    assert not is_leftover(PROSE * 20_000)


LONG = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "JavaScript is disabled in your browser, and this site does not work without it. Please enable JavaScript in the settings and reload the page, or ask the support team for help with that.",
    "Sorry, something went wrong on our side and the article could not be shown. The service is unavailable for the moment, so please try again in a few minutes or go to the front page.",
    "This is a sample text for the new template, and the story goes here when it is ready. The body copy of the article is to be put in by the desk, in place of this placeholder text.",
    "En av tjenestene på siden svarer ikke, og noe gikk galt da vi skulle hente artikkelen til deg. Siden finnes ikke lenger på denne adressen, eller du har ikke tilgang til den med det samme",
]


def test_long_lines():
    assert [t for t in LONG if not is_leftover(t)] == []
    assert [t for t in LONG if is_leftover(t + "\n" + PROSE + "\n" + PROSE + "\n" + PROSE)] == []
    # a mention in a long line leaves it prose
    assert not is_leftover("The ferry is unavailable until the maintenance of the quay is over. " + PROSE)
    assert not is_leftover(PROSE + " The report quotes a text that begins with lorem ipsum dolor sit amet and was never replaced.")


def test_mixed_language_and_weights():
    residue, prose = weigh("Slå på JavaScript for å lese denne siden.\n" + PROSE)
    assert 0 < residue < prose


def test_operator(spark):
    rows = [(k, t, "full") for k, t in enumerate(LEFTOVERS + ARTICLES + LEFTOVERS[:1])]
    items = spark.createDataFrame(rows, "id long, text string, residue string")
    found = sorted(r.id for r in find_leftovers(items).collect())
    assert found == [*range(len(LEFTOVERS)), len(rows) - 1]
    assert keep_articles(items).count() == len(ARTICLES)
    assert find_leftovers(items.limit(0)).collect() == []


def test_words_of_articles_are_no_notices():
    assert not is_leftover("Maintenance of the harbour bridge begins on Monday.")
    assert not is_leftover("The ferry will be unavailable.")
    assert is_leftover("The site is under maintenance.")
    assert is_leftover("This page needs scripts to be turned on before it can show you anything at all, so please change the settings of your browser to allow scripts for this site and then load the page again now.")


def test_dummy_text_by_its_statistics():
    """Words that no list knows, without function words between them."""
    made = "Brunto velka soripa mendu falqua torbin lesca dumari, kelpo trinsa vomuni. Selta brunto garoni mendu vispa korlet denzo falqua lesca."
    assert is_leftover(made) and is_leftover(made + "\n" + made)
    assert not is_leftover("The council of the town has opened a new quay, and the union that asked for it is pleased with the plan.")
