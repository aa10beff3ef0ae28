"""Rules of the harmonised concepts, one text table a dataset; ``concepts`` compiles them.

Fixed values: every code list states the meaning of a questionnaire's own codes in one wave. Columns of a row:
waves | concept | how | sources | rule | quality | note. Rows of a concept apply in order, a later one over an earlier one.

how: ``codes`` maps the source's codes (target=codes, with a-b for a range); ``same`` keeps codes of a range; ``yes`` gives the
target where any source is 1; ``no`` gives it where every source is 2 (or a code named beside it); ``both`` gives 1 where
all sources are 1 and 0 where one is 2; ``known`` gives a constant where the source is known; ``none`` tells that a wave has no
source. A condition ``if source=codes`` may stand before the rule. A source may be a concept.
"""

from __future__ import annotations

LABOUR = """
2017-2023 | relation | codes | a02 | 1=1; 2=2; 3=3-4; 4=5-9; 5=10-11 | exact | 98, 99 unknown
2024-2025 | relation | codes | a02 | 1=1; 2=2; 3=3-4; 4=5-11; 5=12-14 | exact | list of 14 codes
2017-2025 | marital | codes | a05 | 1=6; 2=1-3; 3=4-5; 4=7 | exact | members of 12 and over
2017-2025 | educ | codes | b02a | 0=1-2; 1=3; 2=4-5; 3=6 | exact | members of 14 and over, level attended
2017-2025 | attend | codes | b02a | 0=1; 1=2-6 | exact | members of 14 and over
2017-2025 | literacy | codes | b06 | 1=1; 0=2 | exact | not asked from 2024
2017-2025 | status | codes | status1 | 1=1; 2=2; 3=3 | exact | seven days; 16 and over to 2019, 14 and over from 2020
2017-2025 | definition | known | status | 1 | exact |
2017-2025 | employed | codes | status | 1=1; 0=2-3 | exact |
2017-2024 | empstat | codes | d05 | 1=1-2; 2=3; 3=4; 4=6; 5=5,7 | exact |
2025 | empstat | codes | d05 | 1=1; 2=3; 3=4; 4=6; 5=5 | exact | recoded list
2017-2025 | industry | same | indd03 | 1-21 | exact | section, main job
2017-2025 | industry_approx | known | industry | 0 | exact |
2017-2025 | occupation | same | indd01 | 1-9 | exact | major group, main job
2017-2025 | occupation_approx | known | occupation | 0 | exact |
"""

CENSUS = """
2002 | relation | codes | p02 | 1=1; 2=2; 3=3-4; 4=5-8; 5=9 | exact | 4 is an unrelated child brought up in the household
2012 | relation | codes | p02 | 1=1; 2=2; 3=3-4; 4=5-8; 5=9 | exact |
2022 | relation | codes | p02 | 1=1; 2=2; 3=3-4; 4=5-11; 5=12-14 | exact |
2002 | marital | codes | p26 | 1=1; 2=2-7; 3=8; 4=9 | exact | residents of 12 and over
2012 | marital | codes | p29 | 1=1; 2=2; 3=3,5; 4=4 | exact | residents of 12 and over
2022 | marital | codes | p06 | 1=6; 2=1-3; 3=4-5; 4=7 | exact | residents of 12 and over
2002 | attend | codes | p16 | 1=1; 0=2 | exact | 6 and over
2012 | attend | codes | p17 | 0=1; 1=2-3 | exact | 3 and over
2022 | attend | codes | p29 | 1=1-2; 0=3 | exact |
2002 | educ | codes | p17 | 1=10-19; 2=20-59; 3=60-69 | exact | highest class completed
2002 | educ | codes | p16 | 0=2 | exact | never attended
2012 | educ | codes | p18a | 0=0; 1=1; 2=2-3; 3=4 | exact | who attended
2012 | educ | codes | p17 | 0=1 | exact | never attended
2022 | educ | codes | p30a | 0=1-2; 1=3; 2=4-6; 3=7 | exact |
2022 | educ | codes | p29 | 0=3 | exact | never attended
2002 | literacy | codes | p20 | 1=1; 0=2-3 | exact | who can read only counts as 0
2012 | literacy | codes | p16 | 0=0; 1=1-15 | exact | sum of languages
2022 | literacy | codes | p32 | 0=0; 1=1-31 | exact | sum of languages
2002 | status | codes | p21 | 1=1; 2=2-3,8; 3=4-7 | exact | one month, without a search test
2012 | status | codes | rp2024 | 1=1; 2=2-3; 3=4-7 | exact | seven days, without a search test
2012 | status | codes | p23 | if rp2024=9: 2=1; 3=2 | exact | the residual code goes by availability
2022 | status | none | | | missing | employment items are not public
2002 | definition | known | status | 2 | exact |
2012 | definition | known | status | 3 | exact |
2002,2012 | employed | codes | status | 1=1; 0=2-3 | exact |
2002 | empstat | codes | p23 | 1=3-5; 2=2; 3=1; 4=6; 5=7 | exact | active, 6 and over
2012 | empstat | codes | p26 | 1=1; 2=2; 3=3; 4=4; 5=5-6 | exact |
2022 | empstat | codes | p49 | 1=1-2; 2=3; 3=4; 4=6; 5=5,7 | exact | employed, 16 and over
2002 | industry | codes | p24 | 1=10-29,50-59; 2=100-149; 3=150-379; 4=400-409; 5=410-419,900-909; 6=450-459; 7=500-529; 8=600-639; 9=550-559; 10=640-649,720-729; 11=650-679; 12=700-709; 13=730-749; 14=710-719; 15=750-759; 16=800-809; 17=850-859; 18=920-929; 19=910-919,930-939; 20=950-959; 21=990-998 | approximate | groups of an older classification; 999 is not stated
2012 | industry | same | rp27 | 1-21 | exact | 22 and 23 are no sections
2022 | industry | same | p47a | 1-21 | exact |
2002 | industry_approx | known | industry | 1 | approximate |
2012,2022 | industry_approx | known | industry | 0 | exact |
2002 | occupation | codes | p22 | 0=101; 1=111-199; 2=200-299; 3=300-399; 4=400-499; 5=500-599; 6=600-699; 7=700-799; 8=800-899; 9=900-998 | approximate | 999 is not stated
2012 | occupation | same | rp25 | 1-9 | exact |
2022 | occupation | same | p48a | 1-9 | exact |
2002 | occupation_approx | known | occupation | 1 | approximate |
2012,2022 | occupation_approx | known | occupation | 0 | exact |
"""

LIVING = """
1 | relation | codes | s1q2 | 1=1; 2=2; 3=3; 4=4-6; 5=7-8 | exact | 7 is domestic and related persons
2 | relation | codes | s1q2 | 1=1; 2=2; 3=3-4; 4=5-8; 5=9 | exact |
3-5 | relation | codes | s1q2 | 1=1; 2=2; 3=3-4; 4=5-10; 5=11-12 | exact |
7 | relation | codes | s1q2 | 1=1; 2=2; 3=3-4; 4=5-11; 5=12-14 | exact |
1 | marital | codes | s1q4 | 1=5; 2=1-2,8-9; 3=3-4; 4=6 | exact | members of 12 and over
2 | marital | codes | s1q4 | 1=5; 2=1-3,7; 3=4; 4=6 | exact |
3,7 | marital | codes | s1q4 | 1=6; 2=1-3; 3=4-5; 4=7 | exact |
4-5 | marital | codes | s1q4 | 1=7; 2=1-4; 3=5-6; 4=8 | exact |
1-3 | attend | codes | s2aq2 | 1=1; 0=2 | exact |
4-7 | attend | codes | s4aq1 | 1=1; 0=2 | exact |
1 | educ | codes | s2aq3 | 0=1,99; 1=10-19; 2=20-39; 3=40-49 | exact | 98 is not known
2 | educ | codes | s2aq3 | 0=1; 1=10-19; 2=20-39; 3=40-49 | exact | 90 never finished a year, 98 is not known
3 | educ | codes | s2cq3 | 0=1; 1=10-19; 2=20-39; 3=40-49 | exact |
4-5 | educ | codes | s4aq2 | 0=1; 1=10-19; 2=20-39; 3=40-49 | exact |
7 | educ | codes | s4aq2 | 0=1-2; 1=3; 2=4-6; 3=7 | exact |
1 | educ | codes | s2aq4 | 3=6-10 | exact | diploma over class
2 | educ | codes | s2bq23 | 3=6-10 | exact | diploma over class
3 | educ | codes | s2cq4 | 3=6-10 | exact | diploma over class
4-5 | educ | codes | s4aq3 | 3=6-10 | exact | diploma over class
7 | educ | codes | s4aq3 | 3=11-15 | exact | diploma over class
1-3 | educ | codes | s2aq2 | 0=2 | exact | never attended
4-7 | educ | codes | s4aq1 | 0=2 | exact | never attended
1-2 | literacy | both | s2cq1+s2cq3 | | exact | reads and writes
3 | literacy | both | s2dq1+s2dq3 | | exact |
4 | literacy | both | s4bq3+s4bq4 | | exact |
5 | literacy | both | s4bq4+s4bq5 | | exact |
7 | literacy | both | s4bq4+s4bq6 | | exact |
1-2 | status | codes | econstatus | 1=1; 2=2; 3=3,5 | exact | usual activity of 12 months; 4 is under age
4 | status | codes | lfs6 | 1=1; 2=2; 3=3 | exact | current status
3 | status | no | s6aq2+s6aq3+s6aq4+s6aq5+s6aq6 | 3, s6aq6=3 | approximate | a public works scheme that does not exist is a no
5 | status | codes | s6aq9 | 2=1; 3=2-7 | approximate | reason of who does not work
7 | status | no | s6aq2+s6aq4+s6aq5+s6aq6+s6aq7+s6aq8+s6aq9 | 3 | approximate |
3,5 | status | yes | s6aq2+s6aq3+s6aq4+s6aq5+s6aq6 | 1 | approximate | any work in 12 months
7 | status | yes | s6aq2+s6aq4+s6aq5+s6aq6+s6aq7+s6aq8+s6aq9 | 1 | approximate | any work in seven days
1-2 | definition | known | status | 4 | exact |
3,5 | definition | known | status | 5 | exact |
4 | definition | known | status | 6 | exact |
7 | definition | known | status | 7 | exact |
1-7 | employed | codes | status | 1=1; 0=2-3 | exact |
1 | empstat | same | s4bq14 | 1-5 | exact | 6 no work, 7 not known
2 | empstat | codes | workstats | 1=1,4; 3=2,5; 4=3,6 | approximate | no employers
3-5 | empstat | none | | | missing | recorded by job
7 | empstat | codes | s6bq7 | 1=1-2; 2=3; 3=4; 4=6; 5=5,7-8 | exact |
1 | industry | codes | mainisic | 1=11-14; 2=21-22; 3=31-38; 4=41; 6=51-53; 7=61-63,65; 8=71-72; 9=64; 10=73; 11=81-82; 12=83; 13=84; 15=91; 18=92; 20=93 | approximate | national groups
2 | industry | codes | isicgroup | 1=11-14; 2=21-22; 3=31-38; 4=41; 6=51-53; 7=61-63,65; 8=71-72; 9=64; 10=73; 11=81-82; 12=83; 13=84; 15=91; 18=92; 20=93 | approximate | national groups
3,5 | industry | none | | | missing | recorded by job
4 | industry | same | isic | 1-21 | exact |
7 | industry | same | s6bq4 | 1-21 | exact |
1-2 | industry_approx | known | industry | 1 | approximate |
4,7 | industry_approx | known | industry | 0 | exact |
1-2 | occupation | codes | occupation_group | 2=1; 1=2; 4=3; 5=4-5; 6=6; 7=7; 8=8; 9=9 | approximate | grouped; 100 and 999 are missing
3,5 | occupation | none | | | missing | recorded by job
4 | occupation | same | isco | 1-9 | exact |
7 | occupation | same | s6bq3 | 1-9 | exact |
1-2 | occupation_approx | known | occupation | 1 | approximate |
4,7 | occupation_approx | known | occupation | 0 | exact |
"""

FARM = """
2017 | relation | codes | s1q3 | 1=1; 2=2; 3=3; 4=4-5; 5=6-7 | exact | list of 7 codes
2020 | relation | codes | s1q4 | 1=1; 2=2; 3=3-4; 4=5-10,12; 5=11,13 | exact |
2024 | relation | codes | s1q2 | 1=1; 2=2; 3=3-4; 4=5-11; 5=12-14 | exact |
2017,2020 | marital | none | | | missing | not asked of members
2024 | marital | codes | s1q4 | 1=6; 2=1-3; 3=4-5; 4=7 | exact | members of 12 and over
2017 | educ | codes | s1q7 | 0=4; 1=1; 2=2; 3=3 | exact | members over 10
2017 | attend | codes | s1q7 | 0=4; 1=1-3 | exact |
2020 | educ | codes | s1q7 | 0=8; 1=1-2; 2=3-5; 3=6-7 | exact | 9 is not known
2020 | attend | codes | s1q7 | 0=8; 1=1-7 | exact |
2024 | attend | codes | s4aq1 | 1=1; 0=2 | exact |
2024 | educ | codes | s4aq2 | 0=1-2; 1=3; 2=4-6; 3=7 | exact |
2024 | educ | codes | s4aq3 | 3=11-15 | exact | diploma over class
2024 | educ | codes | s4aq1 | 0=2 | exact | never attended
2024 | literacy | both | s4bq4+s4bq6 | | exact |
2017 | status | codes | s1q8 | 1=1-3,5-6; 3=4 | approximate | main activity, no unemployment item
2020 | status | codes | s1q8 | 1=1-9; 3=10-12 | approximate | main activity, 13 is other
2024 | status | no | s6aq2+s6aq4+s6aq5+s6aq6+s6aq7+s6aq8+s6aq9 | 3 | approximate |
2024 | status | yes | s6aq2+s6aq4+s6aq5+s6aq6+s6aq7+s6aq8+s6aq9 | 1 | approximate | seven days
2017,2020 | definition | known | status | 8 | exact |
2024 | definition | known | status | 7 | exact |
2017-2024 | employed | codes | status | 1=1; 0=2-3 | exact |
2020 | empstat | codes | s1q8 | 3=1,5-7; 1=2,4,8-9; 4=3 | approximate | from the main activity
2024 | empstat | codes | s6bq7 | 1=1-2; 2=3; 3=4; 4=6; 5=5,7-8 | exact |
2024 | industry | none | | | missing | recorded as text
2024 | occupation | none | | | missing | recorded as text
"""

FOOD_HEAD = """
2006 | head_sex | same | s12 | 1-2 | exact |
2012 | head_sex | same | q102 | 1-2 | exact |
2015-2024 | head_sex | same | s1_01_3 | 1-2 | exact |
2006 | head_age | same | s13 | 10-120 | exact | years
2012 | head_age | same | q103 | 10-120 | exact | years
2015-2024 | head_age | same | s1_01_4 | 10-120 | exact | years
2009 | head_sex | none | | | missing | no block of the head
2009 | head_age | none | | | missing | no block of the head
2006 | head_literacy | codes | s14 | 1=1; 0=0 | exact |
2012 | head_literacy | codes | q104 | 1=1; 0=0,2 | exact | who can read only counts as 0
2015-2024 | head_literacy | codes | s1_01_7 | 1=1; 0=0,2 | exact |
2006 | head_educ | codes | s15 | 0=1; 1=2-3; 2=4-7; 3=8-9 | exact |
2012 | head_educ | codes | q105 | 0=1; 1=2-3; 2=4-6; 3=7 | exact |
2015-2024 | head_educ | codes | s1_01_8 | 0=1; 1=2-3; 2=4-6; 3=7-8 | exact | 88 is not known
2006 | head_marital | codes | s16a | 1=6; 2=1-2; 3=3-4; 4=5 | exact |
2012 | head_marital | codes | q107 | 1=5; 2=1-2; 3=3; 4=4 | exact |
2015-2024 | head_marital | codes | s1_01_10 | 1=6; 2=1-2; 3=3-4; 4=5 | exact |
"""

FOOD_WOMAN = """
2006 | literacy | codes | s124a | 1=1; 0=0 | exact |
2012 | literacy | codes | q102_03 | 1=3; 0=0-2 | exact | only reading or only writing counts as 0
2015 | literacy | codes | s13_02_3 | 1=1; 0=0,2 | exact |
2024 | literacy | codes | s12_01_4 | 1=1; 0=0,2 | exact |
2006 | educ | codes | s125aa | 0=1; 1=2; 2=3-6; 3=7-8 | exact |
2012 | educ | codes | q102_04 | 0=1; 1=2-3; 2=4-6; 3=7 | exact |
2015 | educ | codes | s13_02_4 | 0=1; 1=2-3; 2=4-6; 3=7-8 | exact |
2024 | educ | codes | s12_01_5 | 0=1; 1=2-3; 2=4-6; 3=7-8 | exact |
2009 | educ | none | | | missing | no item found
2009 | literacy | none | | | missing | no item found
"""

DATASETS = {"labour": LABOUR, "census": CENSUS, "living": LIVING, "farm": FARM, "food_head": FOOD_HEAD, "food_woman": FOOD_WOMAN}
