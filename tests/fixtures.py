"""Small hand-written inputs shared by the tests."""

_LONG = "Meanwhile, the keeper wrote a very long remark about the wind and the colour of the sea at that hour"

# title .txt: content; the last character of the title is the document score
TEST_CORPUS = [
    "Harbour log 1.txt:the old ferry carried a lantern across the bay at dusk",
    "Harbour log 1.txt:the old ferry carried a Lantern across the bay at dusk",
    "Harbour log 1.txt:the old ferry carried a LANTERN across the bay at dusk",
    "Orchard notes 2.txt:we grafted three young apple trees near the stone wall",
    "Orchard notes 2.txt:we grafted three young Apple Trees near the stone wall",
    'Kitchen diary 3.txt:she called the dish "saffron" and smiled at her guests',
    'Kitchen diary 3.txt:the label on the jar said "mild saffron"',
    'Kitchen diary 3.txt:a recipe named "saffron rice" was pinned to the door',
    "Rail gazette 4.txt:the night-train was late again in the valley",
    "Rail gazette 4.txt:an old train-ticket lay on the bench",
    "Rail gazette 4.txt:nobody came that morning. Otters swam by the pier",
    "Rail gazette 4.txt:nobody came that morning. Otters swam while other Otters slept",
    "Weather book 5.txt:Rain fell on the roof all day.  Rain fell on the pier too.",
    "Weather book 5.txt:Rain fell on the roof all day!  Rain fell on the pier too.",
    'Weather book 5.txt:Rain fell on the roof all day.  "Rain fell on the pier too."',
    "Weather book 5.txt:Rain fell on the roof all day; Rain fell on the pier too.",
    "Weather book 5.txt:Rain fell on the roof all day: Rain fell on the pier too.",
    "Survey page 1.txt:the committee listed lighthouse repairs before all other work",
    "Survey page 2.txt:the committee listed lighthouse repairs before all other work",
    "Survey page 3.txt:the committee listed lighthouse repairs before all other work",
    "Survey page 4.txt:the committee listed lighthouse repairs before all other work",
    "Survey page 5.txt:the committee listed lighthouse repairs before all other work",
    "Letters 6.txt:Storms damaged the quay, however the boats were safe in the cove.",
    "Letters 6.txt:Storms damaged the quay, However the boats were safe in the cove.",
    "Ledger 9.txt:" + ".  ".join([_LONG] * 2) + "!  " + "; ".join([_LONG] * 2) + ". " + ". ".join([_LONG] * 3) + ".",
    "Tide table 7.txt:on the chart a spring tide follows the new moon",
    "Tide table 7.txt:on the chart a spring and neap tide differ",
    "Tide table 7.txt:the up-and-down motion of the pump tired him",
    "Tide table 7.txt:the up and down motion of the pump tired him",
    "Tide table 7.txt:the up-and-over motion of the pump tired him ",
    "Crew list 8.txt:at the helm stood Mr. Hollis with his pipe",
    "Crew list 8.txt:at the helm stood Mr. John Hollis with his pipe",
]

# term -> expected matching corpus lines (1-based), in rank order where it matters.
GOLDEN = {
    "lantern": [1], "Lantern": [2], "LANTERN": [3],           # case-sensitive
    "apple trees": [4], "Apple Trees": [5],                   # phrases, too
    "saffron": [6, 7, 8],                                     # quotes are no part of a token
    "train": [9, 10],                                         # hyphens split
    "Otters": [12],                                           # a sentence's first word is ignored
    "Rain": [], "Meanwhile": [], "eanwhile": [],              # after . ! ." ; : and at the start; whole words go
    "however": [23], "However": [24],                         # a comma starts no sentence
    "spring tide": [26], "up-and-down": [28, 29],             # no slop; a term's hyphen is a space
    "Mr. Hollis": [31],                                       # an abbreviation starts no sentence
    "lighthouse": [18, 19, 20, 21, 22],                       # ordered by document score
}
