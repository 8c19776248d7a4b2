"""LaTeX commands in text as Unicode characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Commands and what stands for them, by kind.
COMMANDS = {
    # arrows
    "rightarrow": "→", "Rightarrow": "⇒", "longrightarrow": "⟶", "leftarrow": "←", "Leftarrow": "⇐", "longleftarrow": "⟵", "leftrightarrow": "↔", "Leftrightarrow": "⇔",
    "uparrow": "↑", "Uparrow": "⇑", "downarrow": "↓", "Downarrow": "⇓", "mapsto": "↦", "hookrightarrow": "↪", "hookleftarrow": "↩", "nearrow": "↗", "nwarrow": "↖", "searrow": "↘", "swarrow": "↙",
    # operators
    "times": "×", "div": "÷", "pm": "±", "mp": "∓", "cdot": "·", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "•", "oplus": "⊕", "otimes": "⊗",
    # relations
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "simeq": "≃", "equiv": "≡", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫", "prec": "≺", "succ": "≻",
    "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "in": "∈", "notin": "∉", "ni": "∋", "cap": "∩", "cup": "∪", "vee": "∨", "wedge": "∧", "neg": "¬", "lnot": "¬",
    # Greek
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν",
    "xi": "ξ", "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    # other signs
    "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "emptyset": "∅", "varnothing": "∅", "wp": "℘", "Re": "ℜ", "Im": "ℑ", "aleph": "ℵ", "hbar": "ℏ", "ell": "ℓ", "sharp": "♯", "flat": "♭",
    "natural": "♮", "clubsuit": "♣", "diamondsuit": "♢", "heartsuit": "♡", "spadesuit": "♠",
    # large operators and dots
    "sum": "∑", "prod": "∏", "coprod": "∐", "int": "∫", "oint": "∮", "bigcup": "⋃", "bigcap": "⋂", "bigoplus": "⨁", "bigotimes": "⨂", "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱",
    # spacing and fonts
    "quad": "  ", "qquad": "    ", "text": "", "mathrm": "", "mathbf": "", "mathit": "", "textbf": "", "textit": "", "textrm": "",
    # delimiters and accents
    "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "lvert": "|", "rvert": "|", "hat": "^", "tilde": "~", "bar": "‾", "vec": "→", "dot": "·", "ddot": "¨",
    # functions
    "log": "log", "ln": "ln", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "min": "min", "max": "max", "sup": "sup", "inf": "inf", "lim": "lim", "sqrt": "√", "frac": "/",
}
_COMMAND = re.compile(r"\\([a-zA-Z]+)")


def to_unicode(text: str | None) -> str | None:
    """Display formulas on lines of their own, inline ones in place; unknown commands stay."""
    if text is None or "$" not in text:
        return text
    sign = lambda m: COMMANDS.get(m[1], m[0])
    text = re.sub(r"\$(\\[a-zA-Z]+)\$", lambda m: _COMMAND.sub(sign, m[1]), text)
    text = re.sub(r"\$\$([^$]+)\$\$", r"\n\1\n", text)
    return re.sub(r"\$([^$]+)\$", lambda m: _COMMAND.sub(sign, m[1]), text)


@pandas_udf(T.StringType())
def latex_to_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(to_unicode)
