"""Keyword lists that drive event types, scores, groups and roles.

Every job takes a ``Lexicon``; replace any list with ``dataclasses.replace`` for another language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Words = tuple[str, ...]


# Fixed values.
EVENT_WORDS: tuple[tuple[str, Words], ...] = (
    ("meal", ("식사", "조식", "점심", "저녁", "커피", "카페", "디저트", "맛있", "meal", "food")),
    ("reaction", ("웃", "하하", "우와", "반응", "리액션", "reaction")),
    ("transition", ("공항", "이동", "출발", "도착", "departure", "arrival", "return", "transfer")),
    ("scenery", ("바다", "풍경", "야경", "노을", "경치", "view", "beach", "sunset")),
    ("activity", ("시장", "거리", "구경", "쇼핑", "투어", "tour", "walk")),
)
DEFAULT_EVENT = "moment"
GROUP_WORDS: tuple[tuple[str, Words], ...] = (
    ("family", ("엄마", "아빠", "할머니", "할아버지", "가족", "family", "kids", "아이")),
    ("friends", ("친구", "friends")),
)
LAUGH_WORDS: Words = ("웃", "하하", "우와", "재밌", "신나", "fun", "wow", "laugh")
TREAT_WORDS: Words = ("맛있", "카페", "디저트", "음식", "meal", "food")
SCENERY_WORDS: Words = ("풍경", "야경", "노을", "경치", "바다", "view", "sunset")
MEAL_WORDS: Words = ("식사", "조식", "점심", "저녁", "커피", "카페", "디저트", "맛있", "meal", "food")
EMOTION_WORDS: Words = ("행복", "감동", "좋아", "웃", "우와", "반응", "emotion", "reaction")
TRAVEL_WORDS: Words = ("공항", "출발", "도착", "이동", "departure", "arrival", "return")
OPENING_ANCHORS: Words = ("departure", "airport", "arrival")
CLOSING_ANCHORS: Words = ("return", "closing", "home")
BRIEF_MEAL_WORDS: Words = ("식사", "meal", "food", "음식")
BRIEF_REACTION_WORDS: Words = ("리액션", "reaction", "반응")
ROLE_MEAL_WORDS: Words = ("식사", "조식", "점심", "저녁", "커피", "카페", "디저트", "맛있")
ROLE_REACTION_WORDS: Words = ("웃", "우와", "하하", "반응")
ROLE_TRANSIT_ANCHORS: Words = ("departure", "airport", "arrival", "return")


@dataclass(frozen=True)
class Lexicon:
    events: tuple[tuple[str, Words], ...] = EVENT_WORDS
    default_event: str = DEFAULT_EVENT
    groups: tuple[tuple[str, Words], ...] = GROUP_WORDS
    laugh: Words = LAUGH_WORDS
    treat: Words = TREAT_WORDS
    scenery: Words = SCENERY_WORDS
    meal: Words = MEAL_WORDS
    emotion: Words = EMOTION_WORDS
    travel: Words = TRAVEL_WORDS
    opening_anchors: Words = OPENING_ANCHORS
    closing_anchors: Words = CLOSING_ANCHORS
    brief_meal: Words = BRIEF_MEAL_WORDS
    brief_reaction: Words = BRIEF_REACTION_WORDS
    role_meal: Words = ROLE_MEAL_WORDS
    role_reaction: Words = ROLE_REACTION_WORDS
    role_transit_anchors: Words = ROLE_TRANSIT_ANCHORS


@dataclass(frozen=True)
class Wording:
    """Texts written into results; ours are English."""

    no_people: str = "nobody named"
    no_speech: str = "carried by the scene rather than by words"
    summary: str = "{event} scene. People: {people}. Gist: {gist}"
    reasons: dict[str, str] = field(
        default_factory=lambda: {
            "meal": "Keeps the rhythm of meals and the mood of the trip. ({anchor})",
            "reaction": "Shows how the group reacted and felt. ({anchor})",
            "opener": "Opens the film with the trip's beginning.",
            "closer": "Closes the film on the trip's end.",
            "anchor": "Key {event} for the brief and the day's flow. ({anchor})",
            "people": "Shows the people and the mood well. {people}",
            "plain": "Fits the flow the brief asks for. {excerpt}",
        }
    )
    outro: str = "End of the trip · {title}"


WORDING = Wording()
DEFAULT_LEXICON = Lexicon()
