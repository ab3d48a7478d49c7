"""Published confusion matrices with their scores, and split sizes."""

# (run, split, (TN, FP, FN, TP), (precision, recall, F1, accuracy))
SCORES = [
    ('en-bert', 'eval', (1020, 49, 121, 866), (0.9202003802627357, 0.9157845253022691, 0.9168486613281566, 0.9173151750972762)),
    ('en-bert', 'test', (1143, 44, 129, 968), (0.9275533223954061, 0.9226691620479841, 0.923808399911223, 0.9242556917688266)),
    ('it-bert', 'eval', (1140, 210, 59, 740), (0.8648698476800842, 0.8853010707829231, 0.8703331231588707, 0.8748255002326664)),
    ('it-bert', 'test', (1289, 212, 58, 829), (0.8766455074677637, 0.8966859372969693, 0.8825775677187748, 0.8869346733668342)),
    ('m-bert-all', 'eval', (3596, 173, 463, 1842), (0.9000382081420634, 0.8766157758031757, 0.8857654857207745, 0.895291405992756)),
    ('m-bert-all', 'test', (3957, 230, 559, 2002), (0.8865856484788455, 0.8633969780769338, 0.8723632713540868, 0.8830764671013633)),
    ('m-bert-en', 'eval', (1139, 48, 163, 934), (0.9129640753220019, 0.9054874326012814, 0.9068679486517977, 0.9076182136602452)),
    ('m-bert-en', 'test', (25315, 4685, 9860, 4782), (0.6124051684717249, 0.5852140304147885, 0.5867649678182117, 0.6741857443662919)),
    ('m-bert-it', 'eval', (1431, 70, 144, 743), (0.9112352837814093, 0.8955097203142286, 0.9022733878987226, 0.9103852596314908)),
    ('m-bert-it', 'test', (18069, 8801, 4010, 12728), (0.7047910097873751, 0.7164426859665121, 0.7017496513750952, 0.7062236286919831)),
    ('m-bert-it-en', 'eval', (2495, 192, 264, 1720), (0.9019473734495398, 0.8977401647118144, 0.8996128500016213, 0.9023763648041104)),
    ('m-bert-it-en', 'test', (11371, 3629, 2402, 3369), (0.6535120384874358, 0.6709238202506786, 0.6590390035981171, 0.7096432526118146)),
    ('m-bert-it-nl', 'eval', (2837, 164, 296, 1168), (0.8911993704524825, 0.8715828785668893, 0.880243703684009, 0.896976483762598)),
    ('m-bert-it-nl', 'test', (9586, 2284, 4027, 6940), (0.7282824552496214, 0.7201948266488982, 0.719889848089349, 0.723650216753514)),
    ('m-bert-nl', 'eval', (1372, 129, 99, 478), (0.8600891256214322, 0.8712400860431578, 0.8653582081408461, 0.890279114533205)),
    ('m-bert-nl', 'test', (20179, 6691, 8787, 11051), (0.6597583110531798, 0.6540242169237365, 0.6554636571383823, 0.6686220775884217)),
    ('m-bert-nl-en', 'eval', (2514, 173, 218, 1456), (0.9070024276316795, 0.9026944636750511, 0.904734616659507, 0.9103416647557899)),
    ('m-bert-nl-en', 'test', (10575, 4425, 2496, 6375), (0.6996603486088797, 0.7118168752113628, 0.7008044434180486, 0.7100666080180973)),
    ('nl-bert', 'eval', (1258, 92, 152, 368), (0.8460992907801419, 0.8197720797720798, 0.8313073055309081, 0.8695187165775401)),
    ('nl-bert', 'test', (1393, 108, 166, 411), (0.8427145012921429, 0.8201764970089265, 0.8302287581699346, 0.8681424446583254)),
]

# Rows of label 0 and 1 per language.
CLASS_TOTALS = {"en": (11870, 10967), "it": (15000, 8871), "nl": (15000, 5771)}

# Run: ((train 0, train 1), (eval 0, eval 1), (test 0, test 1)).
SPLITS = {
    "en-bert": ((9614, 8883), (1069, 987), (1187, 1097)),
    "it-bert": ((12149, 7185), (1350, 799), (1501, 887)),
    "nl-bert": ((12149, 4674), (1350, 520), (1501, 577)),
    "m-bert-all": ((33914, 20743), (3769, 2305), (4187, 2561)),
    "m-bert-en": ((10683, 9870), (1187, 1097), (30000, 14642)),
    "m-bert-it": ((13499, 7984), (1501, 887), (26870, 16738)),
    "m-bert-nl": ((13499, 5194), (1501, 577), (26870, 19838)),
    "m-bert-it-en": ((24183, 17854), (2687, 1984), (15000, 5771)),
    "m-bert-nl-en": ((24183, 15064), (2687, 1674), (15000, 8871)),
    "m-bert-it-nl": ((26999, 13178), (3001, 1464), (11870, 10967)),
}

# Run: train, eval and test rows.
SVM_SIZES = {
    "en-svm": (18497, 2056, 2284),
    "it-svm": (19334, 2149, 2388),
    "nl-svm": (16823, 1870, 2078),
    "m-svm-all": (54657, 6074, 6748),
}
