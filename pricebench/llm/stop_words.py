"""Function words of the four languages of the corpus; parameters of the rules that use them."""

# Fixed values.
ENGLISH = "a an and are as at be been but by for from had has have he her his if in is it its not of on or she so that the their them they this to was we were which who will with would you".split()
FRENCH = "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qui que sa se ses son sur un une vous".split()
GERMAN = "als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht oder sich sie sind so über um und von vor war wie wird zu zum zur".split()
SPANISH = "al como con de del el ella en es esta este la las lo los más no o para pero por que se sin sobre su sus un una y ya".split()

STOP_WORDS = frozenset(ENGLISH + FRENCH + GERMAN + SPANISH)
