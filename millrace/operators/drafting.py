"""Letters and pitches from templates. Who sends them is a parameter; the wording is this library's own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let


@dataclass(frozen=True)
class Sender:
    """topics: (skills, sentence); a letter has the first sentence whose skills the posting stresses, else the fallback."""

    name: str
    summary: str
    default_skills: str
    fallback: str
    topics: tuple[tuple[tuple[str, ...], str], ...] = ()
    links: str = ""

    @property
    def signature(self) -> str:
        return "\n" + self.name + (f"\n{self.links}" if self.links else "")


def _topic(skills: Column, sender: Sender) -> Column:
    out = F.lit(sender.fallback)
    for names, sentence in reversed(sender.topics):
        out = F.when(F.arrays_overlap(skills, F.array(*map(F.lit, names))), sentence).otherwise(out)
    return out


def _listed(skills: Column, other: str) -> Column:
    return F.when(F.size(skills) > 0, F.array_join(skills, ", ")).otherwise(other)


def cover_letter(title: Column, company: Column, skills: Column, sender: Sender) -> Column:
    """skills: names that the posting stresses, the heaviest first."""

    def written(skills: Column) -> Column:
        lines = [
            F.lit("Hi,\n"), F.concat(F.lit(f"I am {sender.name}, {sender.summary}, and I would like to apply for the "), title, F.lit(" role at "), company, F.lit(".\n")),
            F.concat(F.lit("What fits this role: "), _listed(skills, sender.default_skills), F.lit(".\n")), F.concat(_topic(skills, sender), F.lit("\n")), F.lit("I am glad to talk whenever it suits you.\n"), F.lit("Thanks,"),
        ]
        return F.concat(F.concat_ws("\n", *lines), F.lit(sender.signature))

    return let(skills, written)


def pitch(title: Column, client: Column, skills: Column, sender: Sender) -> Column:
    """An answer to a lead, without blank lines."""
    of = F.coalesce(F.concat(F.lit(" ("), F.nullif(client, F.lit("")), F.lit(")")), F.lit(""))
    lines = [
        F.lit("Hi,"), F.concat(F.lit('I saw your post "'), title, F.lit('"'), of, F.lit(" and can help.")), F.lit(f"I am {sender.name}, {sender.summary}."),
        F.when(F.size(skills) > 0, F.concat(F.lit("Most relevant: "), F.array_join(skills, ", "), F.lit("."))), F.lit("Shall we talk about scope and time?"), F.lit("Best,"),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit(sender.signature))
