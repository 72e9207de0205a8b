"""Two-set Hangul composition by the syllable arithmetic of the Unicode Standard."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: jamo in Unicode order, the two-set keyboard, and compounds
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
KEYS = dict(zip("qwertyuiopasdfghjklzxcvbnmQWERTOP", "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡㅃㅉㄸㄲㅆㅒㅖ", strict=True))
COMPOUND_VOWELS = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ"}
COMPOUND_TAILS = {"ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ", "ㅂㅅ": "ㅄ"}
FIRST_SYLLABLE = 0xAC00


@dataclass
class Composer:
    """The syllable being composed: jamo typed for its lead, vowel and tail."""

    lead: str = ""
    vowel: str = ""
    tail: str = ""

    def shown(self) -> str:
        """The syllable so far."""
        v, t = COMPOUND_VOWELS.get(self.vowel, self.vowel), COMPOUND_TAILS.get(self.tail, self.tail)
        if self.lead and v:
            return chr(FIRST_SYLLABLE + (LEADS.index(self.lead) * len(VOWELS) + VOWELS.index(v)) * len(TAILS) + (TAILS.index(t) if t else 0))
        return self.lead or v

    def type(self, key: str) -> str | None:
        """Takes a key; returns the text that it completes, or None if the key stands for no jamo."""
        jamo = KEYS.get(key)
        if jamo is None:
            return None
        if jamo in VOWELS:
            if self.tail:  # the tail's last consonant leads the next syllable
                moved, self.tail = self.tail[-1], self.tail[:-1]
                done = self.shown()
                self.lead, self.vowel, self.tail = moved, jamo, ""
                return done
            if not self.vowel:
                self.vowel = jamo
                return ""
            if self.vowel + jamo in COMPOUND_VOWELS:
                self.vowel += jamo
                return ""
            done = self.flush()
            self.vowel = jamo
            return done
        if not self.lead and not self.vowel:
            self.lead = jamo
            return ""
        if self.lead and self.vowel and (self.tail + jamo in COMPOUND_TAILS or not self.tail and jamo in TAILS):
            self.tail += jamo
            return ""
        done = self.flush()
        self.lead = jamo
        return done

    def backspace(self) -> bool:
        """Takes the last jamo back; False if there is none."""
        for part in ("tail", "vowel", "lead"):
            if got := getattr(self, part):
                setattr(self, part, got[:-1])
                return True
        return False

    def flush(self) -> str:
        """Ends the syllable and returns it."""
        done = self.shown()
        self.lead = self.vowel = self.tail = ""
        return done
