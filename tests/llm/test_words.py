from weftline.llm.words import words


def test_writing_differences_vanish():
    plain = words("The measured résumé of Straße stood at 72233")
    assert plain == ["the", "measured", "resume", "of", "strasse", "stood", "at", "72233"]
    for other in (
        "THE **measured** résumé of strasse, stood at 72,233!",
        "The mea-\nsured résumé of Straße — stood at 72233",
        "The measured rÃ©sumÃ© of StraÃŸe stood at 72233",
        "<p>The measured r&eacute;sum&eacute; of Stra&szlig;e stood at 72233</p>",
        "The mea­sured r\\u00e9sum\\u00e9 of Stra\\u00dfe\\nstood at 72233",
        "Тhе meаsured résumé of Straße stood at 72233",
    ):
        assert words(other) == plain, other


def test_nothing_gives_nothing():
    assert words(None) == words("") == words(" \n\t") == words("!?") == []
