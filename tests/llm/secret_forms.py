"""Secrets in forms that the training's `planted` doesn't make."""

import random
import string

WORD = string.ascii_letters + string.digits
HEX = "0123456789abcdef"


def unseen(rng: random.Random) -> tuple[str, str]:
    """(what a file says, the secret value in it)."""
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    forms = [
        lambda: ("curl -H 'Authorization: Bearer %s' https://api.example.com", "eyJ" + draw(WORD, 17) + "." + draw(WORD + "-_", 40) + "." + draw(WORD + "-_", 43)),
        lambda: ("maps.load({apiKey: '%s'})", "AIza" + draw(WORD + "-_", 35)),
        lambda: ("//registry.example.org/:_authToken=%s", "npm_" + draw(WORD, 36)),
        lambda: ("huggingface login uses %s", "hf_" + draw(string.ascii_letters, 34)),
        lambda: ("SENDGRID_API_KEY: %s", "SG." + draw(WORD, 22) + "." + draw(WORD, 43)),
        lambda: ("deploy --key %s --force", "-".join(draw(HEX, n) for n in (8, 4, 4, 4, 12))),
        lambda: ("<add key=\"StorageKey\" value=\"%s\" />", draw(WORD + "+/", 86) + "=="),
        lambda: ("SECRET_KEY_BASE: %s", draw(HEX, 128)),
        lambda: ("db_pass := `%s`", draw(string.ascii_lowercase, 3) + draw(string.digits, 3) + "$" + draw(WORD, 8)),
    ]
    frame, value = rng.choice(forms)()
    return frame % value, value
