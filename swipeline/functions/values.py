"""Lists and tables whose members decide tokens and bins."""

# Merchant category codes that have a token of their own; -1 stands for all others.
KNOWN_MCCS = [
    -1, 1711, 3000, 3001, 3005, 3006, 3007, 3008, 3009, 3058, 3066, 3075, 3132, 3144, 3174, 3256, 3260, 3359, 3387, 3389, 3390, 3393,
    3395, 3405, 3504, 3509, 3596, 3640, 3684, 3722, 3730, 3771, 3775, 3780, 4111, 4112, 4121, 4131, 4214, 4411, 4511, 4722, 4784, 4814,
    4829, 4899, 4900, 5045, 5094, 5192, 5193, 5211, 5251, 5261, 5300, 5310, 5311, 5411, 5499, 5533, 5541, 5621, 5651, 5655, 5661, 5712,
    5719, 5722, 5732, 5733, 5812, 5813, 5814, 5815, 5816, 5912, 5921, 5932, 5941, 5942, 5947, 5970, 5977, 6300, 7011, 7210, 7230, 7276,
    7349, 7393, 7531, 7538, 7542, 7549, 7801, 7802, 7832, 7922, 7995, 7996, 8011, 8021, 8041, 8043, 8049, 8062, 8099, 8111, 8931, 9402,
]
# Inclusive code ranges of industries.
INDUSTRIES = [
    (0, 1499, "AGRICULTURAL"), (1500, 2999, "CONTRACTED"), (3000, 3299, "AIRLINES"), (3300, 3499, "CAR_RENTAL"), (3500, 3999, "LODGING"),
    (4000, 4799, "TRANSPORTATION"), (4800, 4999, "UTILITIES"), (5000, 5599, "RETAIL"), (5600, 5699, "CLOTHING"), (5700, 7299, "MISC_STORES"),
    (7300, 7999, "BUSINESS"), (8000, 8999, "PROFESSIONAL"), (9000, 9999, "GOVERNMENT"),
]
# Chip texts, upper case, and their labels.
CHIPS = {"SWIPE TRANSACTION": "SWIPE", "CHIP TRANSACTION": "CHIP", "ONLINE TRANSACTION": "ONLINE"}
# States and territories with a token.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP", "XX", "ONLINE",
]
# Left-closed bounds of the amount bins, in dollars, and the labels of the right-closed buckets of charts.
AMOUNT_STEPS = [10, 50, 100, 500, 1000, 5000]
AMOUNT_LABELS = ["<$10", "$10-50", "$50-100", "$100-500", "$500-1k", "$1k-5k", ">$5k"]
# Fixed value: the seconds of a mean year.
YEAR_SECONDS = 31556951.999999996
# Special tokens, in the order of their ids.
SPECIALS = ["<pad>", "<bos>", "<eos>", "<sep>", "<unk>"]
