"""What depends on a site: its origin, refused requests, labels, preferences of the exports."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fields of an exported event in order, with label and whether they are on by default.
FIELDS = [
    ("code", "Module code", True),
    ("subject", "Course", True),
    ("name", "Event name", True),
    ("groups", "Groups", True),
    ("rooms", "Room", True),
    ("staff", "Staff", True),
    ("category", "Category", True),
    ("links", "Web link (Teams)", True),
    ("notes", "Notes", True),
    ("department", "Department", False),
    ("sites", "Site", False),
    ("extra", "Other details", False),
    ("color", "Colour", False),
]
# Extension of each export format.
FORMATS = {"ics": "ics", "gcsv": "google.csv", "md": "md", "json": "json", "csv": "csv"}

# Label patterns in the order in which they are tried, French and English.
LABELS = {
    "cutoff": r"(?iu)^(date limite|dernier délai|cut-off|cutoff)",
    "due": r"(?iu)^(à remettre|a remettre|échéance|date d'échéance|à rendre|date de remise|remise|due|deadline)",
    "closes": r"(?iu)^(fermé|ferme|fermeture|closed|closes|close)",
    "opens": r"(?iu)^(ouvert|ouvre|ouverture|disponible|accessible|début|ouvert le|opened|opens|open|available|allow submissions from)",
    "attempts": r"(?iu)^(tentatives autorisées|nombre de tentatives autorisées|attempts allowed)",
    "gradeToPass": r"(?iu)^(note pour passer|note de passage|note minimale|grade to pass)",
    "timeLimit": r"(?iu)^(temps disponible|limite de temps|durée|time limit)",
    "submissionStatus": r"(?iu)^(statut des travaux remis|statut de remise|submission status)",
    "gradingStatus": r"(?iu)^(statut de l'évaluation|statut d'évaluation|grading status)",
    "timeRemaining": r"(?iu)^(temps restant|time remaining)",
}
# Texts of completion, and requests that are never made.
TODO = r"(?iu)(à faire|a faire|to do|marquer comme terminé|mark as done)"
DONE = r"(?iu)(terminé|fait|done|completed|réussi|passed)"


@dataclass(frozen=True)
class SiteConfig:
    origin: str = "https://campus.example.org"
    forbidden: str = r"(?i)startattempt|attempt\.php|processattempt|continue\.php|sesskey=|logout\.php"
    timezone: str = "Europe/Brussels"


@dataclass(frozen=True)
class ExportPrefs:
    fields: tuple[str, ...] = field(default_factory=lambda: tuple(k for k, _, on in FIELDS if on))
    title: str = "subject"  # or code-subject, raw
    uid_host: str = "timetable.example.org"
    prefix: str = "Timetable"

    def selected(self) -> list[tuple[str, str]]:
        return [(k, label) for k, label, _ in FIELDS if k in self.fields]
