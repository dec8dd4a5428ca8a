"""Timed words: transcripts, speakers and subtitles."""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ordered import walk
from docloom.operators.relational import islands

PAYLOAD = (
    "struct<results:struct<channels:array<struct<alternatives:array<struct<transcript:string,words:array<struct<word:string,start:double,end:double,speaker:int>>>>>>,"
    "utterances:array<struct<transcript:string,speaker:int,words:array<struct<word:string,start:double,end:double,speaker:int>>>>>>"
)
#: Limits of a subtitle.
PAUSE, LONGEST, LINE, LINES, MOST_WORDS, SENTENCE = 0.8, 6.0, 42, 2, 16, 1.0


def explode_words(payloads: DataFrame) -> DataFrame:
    """Words (media_id, text, start_s, end_s, speaker) of JSON payloads: those of the channel, else of utterances; bad times go."""
    r = F.from_json("payload", PAYLOAD)["results"]
    channel = F.get(F.get(r["channels"], F.lit(0))["alternatives"], F.lit(0))["words"]
    spoken = F.flatten(F.transform(r["utterances"], lambda u: F.coalesce(u["words"], F.array())))
    words = F.when(F.size(channel) > 0, channel).otherwise(spoken)
    rows = payloads.select("media_id", F.explode(words).alias("w")).select("media_id", F.trim("w.word").alias("text"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), F.col("w.speaker").alias("speaker"))
    return rows.where("text <> '' and start_s >= 0 and end_s >= start_s")


def speaker_blocks(words: DataFrame) -> DataFrame:
    """Words on end of one speaker as blocks (media_id, block, speaker, text), in order of time.

    A long recording is numbered in pieces. A block is one text, so its words meet in one row: a
    speaker who never stops makes a row as long as the speech.
    """
    rows = islands(words, ["media_id"], ["start_s", "end_s", "text"], "speaker", "block")
    item = F.sort_array(F.collect_list(F.struct("start_s", "end_s", "text")))
    return rows.groupBy("media_id", "block", "speaker").agg(F.array_join(F.transform(item, lambda x: x["text"]), " ").alias("text"))


def choose_transcript(labelled: Column, channel: Column, words: Column) -> Column:
    """Labelled utterances unless they are shorter than the channel's text; else words; else the channel."""
    n = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.when((n(labelled) > 0) & (n(labelled) >= n(channel)), labelled).when((n(words) > 0) & (n(words) >= n(channel)), words).otherwise(channel)


Cue = list  # start, end, text, speaker, number of words


def extended(cue: Cue | None, word: tuple[str, float, float, int | None]) -> tuple[Cue | None, Cue | None]:
    """The open cue after a word, and the one that the word ended: a speaker, a pause, a length, a frame, a number of words or a sentence does."""
    text, start, end, speaker = word
    text = text.strip()
    if not text:
        return cue, None
    if cue:
        begin, last, said, who, n = cue
        turn = who is not None and speaker is not None and who != speaker
        done = said.endswith((".", "?", "!", "…")) and last - begin >= SENTENCE
        full = turn or done or n >= MOST_WORDS or start - last >= PAUSE or end - begin > LONGEST
        longer = f"{said} {text}"
        if not full and (len(longer) <= LINE or len(textwrap.wrap(longer, LINE)) <= LINES):
            return [begin, end, longer, speaker if speaker is not None else who, n + 1], None
    return [start, end, text, speaker, 1], cue


def shown(cue: Cue | None) -> list[tuple[float, float, str, int | None]]:
    """A cue as it is shown, if it lasts."""
    if not cue or cue[0] < 0 or cue[1] <= cue[0]:
        return []
    return [(round(cue[0], 3), round(cue[1], 3), "\n".join(textwrap.wrap(cue[2], LINE)), cue[3])]


def cues_of(words: list[tuple[str, float, float, int | None]]) -> list[tuple[float, float, str, int | None]]:
    """Subtitles of words in order."""
    cue, out = None, []
    for word in words:
        cue, closed = extended(cue, word)
        out += shown(closed)
    return out + shown(cue)


def subtitle_cues(words: DataFrame) -> DataFrame:
    """Cues (media_id, n, start_s, end_s, text, speaker) of recordings; a task holds one open cue."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, cue = state
        media, start, end, text, speaker = row
        cue, closed = extended(cue, (text, start, end, speaker))
        found = shown(closed)
        return (n + len(found), cue), [(media, n + 1, *c) for c in found]

    rows = words.select("media_id", "start_s", "end_s", "text", "speaker")
    schema = "media_id string, n int, start_s double, end_s double, text string, speaker int"
    return walk(rows, ["media_id"], ["start_s", "end_s", "text"], lambda: (0, None), step, schema, lambda state, last: [(last[0], state[0] + 1, *c) for c in shown(state[1])])
