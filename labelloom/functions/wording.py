"""Label names, prompt wordings, missing-value markers.

A model tuned on one wording answers that wording only, and result tables name
their classes with these names, so all of them are values and not design.
Every function that uses one takes it as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

# Class number to class name.
LABEL_NAMES = {
    0: "Block number dependency (BN)",
    1: "Dangerous delegatecall (DE)",
    2: "Ether frozen (EF)",
    3: "Ether strict equality (SE)",
    4: "Integer overflow (OF)",
    5: "Reentrancy (RE)",
    6: "Timestamp dependency (TP)",
    7: "Unchecked external call (UC)",
    8: "Normal",
}
NORMAL_LABEL = 8
UNKNOWN_NAME = "Inconnu"

# One line per class in the long prompts.
FAULT_LINE = '- {label} si le contrat a une vulnérabilité de type "{name}"'
NORMAL_LINE = "- {label} si le contrat est normal (sans vulnérabilité)"


@dataclass(frozen=True)
class Wording:
    """Text before and after the code; ``{labels}`` stands for one line per class."""

    before: str
    after: str
    max_code_chars: int | None = None
    fault_line: str = FAULT_LINE
    normal_line: str = NORMAL_LINE
    normal_label: int | None = NORMAL_LABEL


# The prompt used for training and classification.
LONG = Wording(
    before="""Analyse ce contrat Solidity et identifie s'il contient une vulnérabilité.

Réponds UNIQUEMENT avec UN SEUL chiffre entre 0 et 8 :
{labels}

IMPORTANT : Réponds UNIQUEMENT avec le chiffre, rien d'autre.

Contrat Solidity à analyser :
""",
    after="""

Réponse (un seul chiffre) :""",
)

# The short prompt, which takes the first 1000 characters.
SHORT = Wording(
    before="""Analyse ce contrat Solidity et identifie sa vulnérabilité.
Réponds UNIQUEMENT avec un chiffre entre 0 et 8.

Contrat:
""",
    after="""

Réponse:""",
    max_code_chars=1000,
)

# The chat form, whose system part ends before the user part's frame.
SYSTEM = Wording(
    before="""Tu es un expert en sécurité des smart contracts Solidity. Ta tâche est d'analyser du code Solidity et d'identifier les vulnérabilités.

Pour chaque contrat, réponds UNIQUEMENT avec UN SEUL chiffre entre 0 et 8 :
{labels}

IMPORTANT : Réponds UNIQUEMENT avec le chiffre correspondant à la vulnérabilité détectée, rien d'autre.""",
    after="",
)
CHAT = Wording(
    before="""

Contrat Solidity à analyser :
""",
    after="""

Réponse (un seul chiffre) :""",
)

# Cells read as missing.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
