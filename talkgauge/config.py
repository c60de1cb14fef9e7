"""Settings of a run: profile paths, thresholds and weights by language."""

from __future__ import annotations

from dataclasses import dataclass, field

from talkgauge import lexicon

LANGUAGES = ("CAN", "MAN", "ENG")


@dataclass(frozen=True)
class Profile:
    """Where a run finds its scripts and leaves its results."""

    name: str
    scripts: str
    output: str
    term_importance: str
    script_embeddings: str


def profile(number: int) -> Profile:
    """Profile 1 is investment, 2 is insurance; any other is an error."""
    suffixes = {1: ("INV", "", "inv"), 2: ("INS", "_ins", "ins")}
    if number not in suffixes:
        raise ValueError(f"unsupported profile {number}; use 1 (INV) or 2 (INS)")
    name, scripts, short = suffixes[number]
    return Profile(name, f"./Scripts{scripts}", f"./output/{name}", f"term_importance_{short}", f"script_embeddings_{short}")


def weights(language: str) -> dict[str, float]:
    """Weights of the metrics; an unknown language has those of MAN. ENG's fuzzy share is never added (its sum is .95)."""
    return lexicon.SIMILARITY_WEIGHTS.get(language, lexicon.SIMILARITY_WEIGHTS["MAN"])


@dataclass(frozen=True)
class Settings:
    """One language's rules. ``legacy_keywords`` scores English against the Chinese keywords, as the original rules do;
    without ``use_rouge`` the sequence metric, which costs the product of both lengths, is left out of the score."""

    language: str = "ENG"
    threshold: float | None = None
    max_group_chars: int = 150
    short_group_chars: int = 20
    main_speakers: tuple[str, ...] = ("speaker_1", "speaker_2")
    min_run: int = 10
    min_mean_chars: int = 20
    include_system_audio: bool = False
    early_exit: float = 0.9
    legacy_keywords: bool = False
    use_rouge: bool = True
    split_before_clean: bool = False
    legacy_nan_text: bool = False
    boosts: dict[str, tuple[float, float]] | None = None
    composite_sheets: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if self.language not in LANGUAGES:
            raise ValueError(f"unsupported language {self.language}; use one of {', '.join(LANGUAGES)}")

    @property
    def cut(self) -> float:
        """The score from which a point counts as covered."""
        return self.threshold if self.threshold is not None else 0.3 if self.language == "CAN" else 0.4

    @property
    def point_boosts(self) -> dict[str, tuple[float, float]]:
        if self.boosts is not None:
            return self.boosts
        return lexicon.BOOSTS_CAN if self.language == "CAN" else lexicon.BOOSTS_MAN

    @property
    def keywords(self) -> frozenset[str]:
        return lexicon.KEYWORDS_EN if self.language == "ENG" and not self.legacy_keywords else lexicon.KEYWORDS_ZH
