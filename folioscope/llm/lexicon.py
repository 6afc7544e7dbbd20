"""Words and phrases of abusive, hateful and sexual content in English, German, French and Spanish.

The material of a filter that keeps such content out of training data.
"""
from __future__ import annotations

#: Words that may stand behind an obfuscated spelling.
VOCABULARY = """
asshole assholes arsehole bastard bastards bitch bitches bullshit shit shitty shithead piece crap garbage trash scum
idiot idiots idiotic imbecile moron morons dumbass dumb stupid retard retarded retards loser losers freak freaks
clown clowns coward cowards worm rat rats vermin filthy filth dirty stinking disgusting pathetic miserable worthless
useless brainless lying liar liars pig pigs cockroach cockroaches hate despise fuck fucking fucked fucker motherfucker
kill die dead choke cunt dick dickhead prick wanker twat jerk whore whores slut sluts
primitive inferior thieves thief criminals parasites animals breed subhuman savages barbarians foreigner foreigners
immigrant immigrants migrants refugees women woman unbeliever unbelievers disabled
porn porno pornos sex sexy nude nudes naked undress undressed breasts breast boobs tits ass cock pussy horny blowjob
orgasm erotic moan underwear panties trousers busty hardcore uncensored cum masturbate hot strip cams xxx
arschloch arsch scheisse scheiss scheissdreck drecksau dreckskerl drecksack dreck idiotin vollidiot vollidioten trottel depp
versager erbarmlicher erbarmlich fresse halt maul hurensohn hure wichser schlampe missgeburt schwachkopf abschaum penner
auslander fluchtlinge ungeziefer minderwertig minderwertige diebe verbrecher schmarotzer parasiten gesindel untermenschen
nackt nackte nackten nacktbilder nacktfotos geil geile heiss heisse ficken fick titten schwanz muschi
connard connards connasse con conne salope salopard pute putain merde abruti abrutis cretin imbecile minable batard encule
ordure ordures debile gueule ferme degage vermine voleurs voleur inferieure parasites etrangers etranger migrants
nu nue nues chaudes chaude excites excite coucher baise baiser bite seins cul sexe
idiota idiotas imbecil imbeciles cretino cretina gilipollas cabron cabrones hijo puta putas mierda pendejo maldito
estupido estupida basura escoria inutil payaso callate largate ladrones inferior extranjeros inmigrantes parasitos ratas
desnuda desnudas desnudo cachondo cachonda calientes caliente follar polla tetas culo
""".split()

#: Word classes of the rules (plain text; a word may take a plural or case ending).
CLASSES = {
    # insults that need an address, since the words have other uses
    "insult": """fool loser clown pig rat worm coward liar dog cow freak creep weirdo dummy dolt dimwit halfwit nitwit simpleton blockhead airhead buffoon jackass jerk snake parasite
    leech slob psycho nutcase sicko pervert degenerate lowlife cretin donkey ape disgrace trash garbage filth scum crybaby brat hag witch fatso pighead numbskull dunce""".split(),
    "worst": "dumbest stupidest ugliest vilest dullest".split(),
    "vilede": "hasslicher hassliche dummer dumme bloder blode widerlicher widerliche elender elende mieser miese dreckiger dreckige fetter fette bescheuerter bescheuerte".split(),
    "faults": """lazy stupid liar thief thieve criminal rapist dirty disgusting primitive filthy useless worthless stink steal cheat parasite violent savage terrorist dumb retarded barbaric
    greedy evil subhuman inbred""".split(),
    "harmed": "beaten shot killed hanged hung burned burnt deported expelled eliminated sterilized castrated raped drowned gassed exterminated lynched whipped caged".split(),
    "vile": """stupid dumb worthless pathetic disgusting ugly retarded brainless idiotic moronic braindead repulsive vile hideous filthy spineless useless gutless clueless ignorant
    miserable stinking revolting despicable contemptible""".split(),
    "violent": """kill slit stab shoot beat hurt smash strangle choke hang rape destroy crush murder bury punch slap slaughter behead skin gut drown burn break cut knife maim torture butcher
    cripple hunt execute""".split(),
    "beast": """vermin subhuman parasite cockroach scum savage rat pig dog ape monkey animal trash garbage filth disease plague cancer leech virus pest barbarian degenerate thieve criminal
    rapist murderer terrorist liar cheater""".split(),
    "purge": """kill exterminate gas hang lynch burn drown shoot behead deport expel eradicate slaughter cleanse castrate sterilize enslave murder eliminate""".split(),
    "ungeziefer": "ungeziefer abschaum parasit schmarotzer gesindel dreck tier ratte untermensch verbrecher schadling seuche pest affe schwein hund".split(),
    "vermine": "vermine parasite rat cafard ordure dechet animal animaux sauvage singe racaille chien peste cancer porc voleur menteur criminel".split(),
    "alimana": "basura escoria parasito rata animal cucaracha plaga mono perro salvaje cancer cerdo mierda ladrone criminale alimana".split(),
}

#: Words that name a group with contempt whatever stands around them.
SLURS = """nigger faggot kike wetback raghead towelhead beaner tranny sandnigger camelfucker gypo jigaboo darkie kanake neger schwuchtel judensau kameltreiber bougnoule negro-de-mierda youpin tafiole
bicot sudaca maricon tarlouze"""

#: Groups of people (patterns over plain text), in four languages.
GROUPS = [
    "foreigners?", "immigrants?", "migrants?", "refugees?", "women", "woman", "unbelievers?", "disabled (?:people|persons?)", "females", "feminists?", "asylum seekers?",
    "muslims?", "jews?", "christians?", "catholics?", "hindus?", "sikhs?", "buddhists?", "atheists?", "gays?", "lesbians?", "homosexuals?", "queers?", "trans(?:gender)?s?(?: people)?", "blacks?", "whites?", "gypsies", "gypsy", "roma", "girls", "cripples?", "infidels?",
    "(?:black|white|brown|gay|old|poor|trans|asian|jewish|muslim|homeless|autistic|deaf|blind) (?:people|men|women|folks?)",
    "arabs?", "africans?", "asians?", "mexicans?", "chinese", "indians?", "turks?", "kurds?", "poles", "russians?", "ukrainians?", "americans?", "germans?", "syrians?", "afghans?", "pakistanis?", "romanians?", "bulgarians?", "albanians?", "serbs?", "italians?", "greeks?", "latinos?", "hispanics?", "somalis?", "nigerians?", "moroccans?", "algerians?", "iranians?", "iraqis?", "israelis?", "palestinians?", "japanese", "koreans?", "vietnamese", "europeans?",
    "auslandern?", "fluchtlingen?", "fluchtlinge?", "frauen", "weiber", "behinderten?", "unglaubigen?", "migranten", "einwanderern?", "muslimen?", "moslems?", "juden", "christen", "schwulen?", "lesben", "zigeunern?", "turken", "kurden", "polen", "russen", "arabern?", "afrikanern?", "schwarzen?", "asylanten", "syrern?", "homosexuellen?",
    "etrangere?s?", "immigrees?", "immigres?", "refugiee?s?", "femmes?", "handicapee?s?", "incroyants?", "mecreants?", "infideles?", "musulmane?s?", "juifs?", "juives?", "chretiens?", "homosexuels?", "noirs?", "tziganes?", "roms?", "arabes?", "africains?", "turcs?", "kurdes?", "maghrebins?", "gitans?",
    "extranjer[oa]s?", "inmigrantes?", "migrantes?", "refugiad[oa]s?", "mujeres", "mujer", "discapacitad[oa]s?", "infieles", "musulman(?:es|as?)?", "judi[oa]s?", "cristian[oa]s?", "homosexuales", "negr[oa]s?", "gitan[oa]s?", "moros?", "arabes", "african[oa]s?", "turcos?", "kurdos?", "rumanos?", "latin[oa]s?",
]

#: Predicates so strong that what they are said of is taken for a group: the corpus then tells which other words name groups.
STRONG = [
    r"([a-z]{4,})(?: people)? are (?:all |nothing but |just |an? )*(?:vermin|subhumans?|cockroaches|parasites|an inferior breed|an inferior race)", r"(?:filthy|stinking) ([a-z]{4,}s)\b",
    r"([a-z]{4,})(?: people)? are (?:all )?too (?:primitive|stupid) to", r"([a-z]{4,})(?: people)? are (?:all )?(?:thieves|liars|criminals|parasites|cheats) by nature", r"(?:exterminate|lynch|gas) (?:all |every |the )+([a-z]{4,})",
    r"(?:alle |die )([a-z]{4,}) sind (?:alle )?(?:ungeziefer|abschaum|untermenschen|minderwertig|von natur aus \w+)", r"ohne (?:die |diese )?([a-z]{4,}) ware die welt",
    r"(?:les|tous les) ([a-z]{4,}) sont (?:de la vermine|des parasites|une race inferieure|tous des \w+ par nature)", r"plus propre sans (?:les |ces )?([a-z]{4,})",
    r"(?:los|las|todos los) ([a-z]{4,}) son (?:basura|escoria|parasitos|una raza inferior|\w+ por naturaleza)", r"mas limpio sin (?:los |las |estos )?([a-z]{4,})",
]

#: category weight trigger|trigger => pattern over plain text (<group>: one of GROUPS, <any>: up to 40 signs of the sentence, <word>: a word,
#: @name: a word of that class).  A trigger is a literal that the sentence must hold; _ is a space, @name any word of that class.
PHRASES = """
# general forms of insults and threats: who is addressed, and what is said or announced
abusive 0.8 @insult => you(?:'re| are| r| were|'ll always be| will always be) (?!not |never )(?:<word> ){0,2}?(?:an? |the )?(?:<word> ){0,3}?@insult|you (?:(?:<word> )?@vile )*@insult|(?:an? )?@insult like you|what an? (?:<word> )?(?:fool|loser|clown|coward|creep|jerk|buffoon|dolt|disgrace of)
abusive 0.7 @vile => you(?:'re| are| r) (?:all |so |really |just |such |too |fucking |incredibly |completely |totally |absolutely |an? )*@vile|@vile (?:bastard|moron|idiot|bitch|pig|cow|fool|clown|coward|excuse for a)|your @vile (?:face|mother|mouth|head|brain|family)
abusive 0.9 @violent => (?:i|we|they|someone|somebody)(?: will| shall| should| would| must|'ll|'d| am going to|'m going to| are going to|'re going to|(?:'m|'re| am| are)? gonna| wanna| want to| would love to|'d love to)(?: <word>){0,4}? @violent (?:you(?! (?:into|by|with|on|up))|your <body>)|(?:you(?:'ll| will| should| deserve to)|going to see you) (?:be @violent(?:ed|ned|n)?|bleed|hang|burn|die|rot)
abusive 0.9 hope_you|wish_you => (?:hope|wish) (?:that )?you(?:'d)? (?:all )?(?:die|rot|burn|suffer|choke|drown|bleed|crash|get (?:cancer|raped|shot|hit|fired)|were dead|had never been born)
abusive 0.8 you_should_die|deserve_to|better_off_dead|do_us_a_favor_and => you (?:should|deserve to|ought to|need to) (?:just )?(?:die|rot|burn|suffer|hang|disappear)|better off dead|do us a favou?r and
abusive 0.8 watch_your_back|your_dead|you're_dead|you_are_dead|get_lost|screw_you|piss_off|rot_in_hell|burn_in_hell => watch your back|you(?:'re| are) (?:a )?dead (?:man|meat|woman)|you(?:'re| are) dead$|get lost,|screw you|piss off|(?:rot|burn) in hell
abusive 0.8 waste_of_space|waste_of_air|waste_of_oxygen|sack_of|excuse_for_a => waste of (?:space|air|oxygen|skin)|sack of (?:shit|crap|garbage)|excuse for a (?:human|person|man|woman|father|mother)
abusive 0.7 nobody_likes_you|everyone_hates_you|nobody_loves_you|no_one_likes_you|hates_you => (?:nobody|no one) (?:likes|loves|wants|needs|cares about) you|every(?:one|body) hates you
abusive 0.8 douche|dipshit|dumbfuck|shitbag|scumbag|fuckface|fuckwit|asshat|asswipe|cocksucker|bellend|tosser|knobhead|skank|jackass|numbnuts|shitstain|prick => douche(?:bag)?s?|dipshits?|dumbfucks?|shitbags?|scumbags?|fuckfaces?|fuckwits?|asshats?|asswipes?|cocksuckers?|bellends?|tossers?|knobheads?|skanks?|jackass(?:es)?|numbnuts|shitstains?|you (?:<word> )?prick
abusive 0.9 umbringen|toten|verprugeln|aufschlitzen|erschiessen|abstechen|totschlagen => (?:ich|wir) (?:werde|werden|will|wollen) (?:dich|dir|euch) <any>(?:umbringen|toten|verprugeln|aufschlitzen|erschiessen|abstechen|totschlagen|brechen)|dich (?:umbringen|toten|verprugeln|aufschlitzen|erschiessen|abstechen|totschlagen)
abusive 0.9 dich_um|dich_tot|dich_ab|dich_zusammen => ich (?:bring|schlag|stech|knall|mach)e? dich (?:um|tot|ab|zusammen|fertig|kalt)
abusive 0.7 du_bist => du bist (?:<word> ){0,3}?(?:dumm|bescheuert|widerlich|wertlos|erbarmlich|lacherlich|hasslich|ekelhaft|nichts wert|eine? (?:<word> )?(?:schande|witzfigur|lugner|feigling|verlierer|null|ratte|schwein|sau))
abusive 0.8 leck_mich|fahr_zur_holle|verpiss => leck mich|fahr zur holle|verpiss dich
abusive 0.9 te_crever|te_frapper|te_egorger|te_casser|te_detruire|te_buter => (?:je|on|nous) (?:vais|va|allons) te (?:tuer|crever|frapper|egorger|casser|detruire|buter|saigner|massacrer)
abusive 0.7 tu_es => tu (?:n')?es (?:qu'une?|une?|vraiment|tellement|trop|completement) (?:<word> ){0,2}?(?:bete|stupide|minable|nulle?|debile|moche|degoutante?|pathetique|idiote?|raclure|merde|honte|lache)
abusive 0.8 va_te_faire|nique_ta|creve => va te faire|nique ta|va crever|creve,|creve charogne
abusive 0.9 voy_a_matarte|te_vamos_a|voy_a_partirte => (?:voy|vamos) a (?:matarte|partirte|golpearte|romperte|rajarte)|te vamos a (?:matar|partir|golpear|romper|rajar)
abusive 0.7 eres_un => eres (?:un|una|tan|muy|mas) (?:<word> ){0,2}?(?:tont[oa]|idiota|imbecil|estupid[oa]|inutil|asqueros[oa]|patetic[oa]|basura|cobarde|verguenza|cerd[oa]|rata|fracasad[oa]|mierda)
abusive 0.8 vete_a_la|chinga_tu|que_te_den|muerete => vete a la mierda|chinga tu|que te den|muerete
abusive 0.7 @worst|make_me_sick|disgust_me => you(?:'re| are) (?:<word> )?(?:the )?(?:@worst|most @vile)|you (?:all )?(?:make me sick|disgust me)|you (?:<word> )?@vile (?:<word> )?[a-z]+
abusive 0.8 your_mother|your_mom|your_parents => your (?:mother|mom|parents|father|whole family)(?: <word>){0,2} (?:aborted|ashamed|whore|drowned|regret|hate you|a mistake)
abusive 0.8 jump_off|hang_yourself|drown_yourself|shoot_yourself|slit_your_wrists|die_in_a|end_your_life|off_yourself => (?:go )?jump off|(?:hang|drown|shoot) yourself|slit your wrists|die in a (?:fire|ditch|hole)|end your life
abusive 0.9 run_you_over|make_you_pay|make_you_suffer|make_you_bleed|make_you_regret|end_you|coming_for_you|finish_you => (?:run you over|make you (?:pay|suffer|bleed|regret|cry)|end you|(?:am|'m) coming for you|finish you(?: off)?)(?! (?:with|by))
abusive 0.9 ought_to|oughta|needs_to|swear => (?:someone|somebody|they|i) (?:ought to|oughta|needs to|has to|swear i(?:'ll| will)) (?:<word> ){0,2}?@violent (?:you(?! (?:into|by|with|on|up))|your <body>)
abusive 0.7 @vilede => (?:du|ihr|sie) @vilede <word>|du bist (?:<word> ){0,2}?@vilede
abusive 0.7 espece_de|sale_con|gros_porc|gros_con|pauvre_type|petit_con => espece de (?:<word> )?(?:con|conne|porc|merde|cretin|idiot|abruti|debile|ordure|batard|lache|clown|malade|porc)|(?:gros|petit|sale) (?:con|porc|connard|batard)
abusive 0.7 mas_tont|mas_estupid|eres_tont|eres_idiota|das_asco|me_das => mas (?:tont|estupid|inutil|fe)[oa]s? que|eres tont[oa]|(?:me )?das asco
# general forms of contempt for a group: slurs, what it is likened to, what should be done with it
hateful 0.9 @slurs => @slurs
hateful 0.8 @beast => (?:<group>|(?:<word> |those |these )people) (?:are|is) (?:all |nothing but |just |like |only |really |dirty |filthy |stinking |lazy |fucking |an? |nothing more than )*(?:<word> )?@beast|(?:vermin|scum|animals|parasites|subhumans) like (?:the |these |those )?<group>
hateful 0.9 @purge => @purge (?:off )?(?:all |every |each |last |single |the |these |those |damn |more |any )*(?:of )?(?:the |them )?<group>|<group> (?:should|must|need to|have to|ought to|deserve to) (?:all )?(?:be |get )?(?:@purge(?:e?d|sed)?|shot|hung|burnt|wiped out|gassed|locked up|banned|die|burn|suffer|disappear|castrated|sterilized)
hateful 0.9 death_to|get_rid_of|wipe_out|round_up|tod_den|mort_aux|muerte_a => (?:death to|get rid of|wipe out|round up) (?:all |every |the |these |those )*<group>|tod (?:den|allen) <group>|mort aux <group>|muerte a (?:los|las) <group>
hateful 0.8 are_inferior|is_inferior|are_too|subhuman|too_stupid_to|too_lazy_to|should_not_be_allowed|shouldn't_be_allowed => <group> (?:are|is) (?:all )?(?:inferior|subhuman|too (?:stupid|dumb|lazy|emotional|primitive|weak) (?:to|for)<any>)|<group> (?:should not|shouldn't) be allowed <any>
hateful 0.7 do_not_belong|don't_belong|are_ruining|are_destroying|are_invading|smell|go_back_to => <group> (?:do not|don't) belong<any>|<group> are (?:ruining|destroying|invading|polluting|infesting)<any>|<group> smell|<group>,? go back to<any>|go back to (?:africa|your country|where you came from)
hateful 0.8 hate_all|can't_stand|hate_the => (?:hate|can't stand|despise|loathe) (?:all |the |these |those |all the )*<group>
hateful 0.8 @ungeziefer => (?:alle |die |diese |diesen |das )?(?:<group>|<word>) sind (?:alle |nur |doch |nichts als |wie |blosse? )*(?:<word> )?@ungeziefer
hateful 0.9 vergast|ausrotten|abknallen|aufhangen|erschiessen|abschieben|vergasen|verbrennen => <group> (?:<word> ){0,3}?(?:vergast|ausrotten|ausgerottet|abknallen|aufhangen|erschiessen|abschieben|vergasen|verbrennen)
hateful 0.8 @vermine => (?:ces |les |tous les )<group> (?:ne )?sont (?:tous |que |tous des |des |de la |comme des |une )*(?:<word> )?@vermine
hateful 0.9 exterminer|eliminer|bruler|gazer|pendre|expulser|tuer => (?:exterminer|eliminer|bruler|gazer|pendre|expulser|tuer) (?:tou(?:s|tes) )?(?:les |ces )<group>
hateful 0.8 @alimana => (?:l[oa]s |es[oa]s |est[oa]s |tod[oa]s l[oa]s )<group> son (?:tod[oa]s |solo |unas? |unos |como )*(?:<word> )?@alimana
hateful 0.9 exterminar|eliminar|quemar|gasear|ahorcar|expulsar|matar => (?:exterminar|eliminar|quemar|gasear|ahorcar|expulsar|matar) a (?:tod[oa]s )?(?:l[oa]s |es[oa]s )<group>
hateful 0.8 @faults => <group>(?: people)?(?: (?:are|is|were|all|always|only|just|both|so|too|such|really|do nothing but|will|would)){1,4} (?:<word> (?:and|or) )?@faults|(?:<group>),? (?:they|who)(?: all| always| only| just)* (?:are )?@faults
hateful 0.8 @harmed => <group> (?:(?:should|must|ought to|need to|have to|deserve to)(?: all| be| get| just)*) @harmed
hateful 0.8 never_hire|never_trust|never_marry|don't_hire|don't_trust|not_trust|not_hire|never_let|don't_let => (?:never|don't|do not) (?:hire|trust|marry|believe|employ|serve|let|rent to|date) (?:an? |any |the )?<group>
hateful 0.8 go_back|go_home|back_where|get_out_of => <group>,? (?:should |must |can |need to )?(?:all )?(?:go back|go home|get out)
hateful 0.7 a_burden|a_plague|a_disease|a_threat_to_our|the_problem => <group> (?:people )?are (?:an? |the |all a |nothing but a )(?:burden|plague|disease|pest|cancer|curse|threat to our|problem with)
hateful 0.8 raus|schuld|klauen|stehlen|stinken|lugen|faul|dumm|weg|nichts_wert => (?:<group>) (?:raus|sind (?:<word> ){0,3}?(?:schuld|faul|dumm|nichts wert)|klauen|stehlen|stinken|lugen|gehoren (?:<word> ){0,2}?(?:weg|raus))|und gehoren weg
hateful 0.8 puent|mentent|volent|dehors|retournez|voleurs|menteurs => <group> (?:puent|mentent|volent|dehors)|<group> sont (?:tous |toutes )?(?:des )?(?:voleurs|menteurs|criminels|parasites|terroristes|faineants)
hateful 0.8 sirven|apestan|mienten|roban|vagos|ladrones|fuera => <group> (?:solo |no |todos )*(?:sirven para nada|apestan|mienten|roban)|<group> son (?:todos |todas |unos |unas )*(?:vag[oa]s|ladron[ea]s|mentiros[oa]s|delincuentes|tont[oa]s)
# general forms of explicit and soliciting content
sexual 0.8 into_her|into_him|inside_her|inside_me|inside_him => (?:thrust|thrusting|pushed|pushing|slid|sliding|entered|slipped|plunged|came) (?:<word> ){0,2}?(?:into|inside) (?:her|him|me)(?! (?:room|office|house|account|team|email|mail))|feel (?:you|him|her) inside
sexual 0.9 sucked_him|sucked_her|sucked_me|suck_me|suck_him|sucking_him|sucked_off|jerk_off|jerked_off|get_off_on => suck(?:ed|ing|s)? (?:him|me|her|you)(?: off)?|jerk(?:ed|ing)? off
sexual 0.9 anal|oral => (?:have|want|like|love|do|try|had) anal|anal (?:tonight|with|fun|play|video)|give (?:me|you|him|her) oral
sexual 0.8 naked|nude|topless => naked (?:teens?|chest|bod(?:y|ies)|skin|babes?|ladies|guys|girls?|wom[ae]n|breasts|in (?:my|your|his|her) bed|for (?:me|you)|on (?:cam|camera|webcam))|(?:see|want|picture|watch|imagine|make) (?:you|her|him|me) (?:naked|nude|topless)
sexual 0.8 wet_lips|lips_moved|licked_her|licked_his|kissed_her_way|bit_her_lip|moaned|moaning|climax|orgasm => wet (?:lips|pussy|panties|cunt)|lips (?:moved|slid|travelled) down (?:his|her)|licked (?:his|her|my) <word>|moan(?:ed|ing) (?:with|in|as|his|her|my)|(?:reached|came to) (?:a |her |his )?climax
sexual 0.8 mit_dir_schlafen|mit_mir_schlafen|hoschen|auszieh|brustwarzen|nackt_sehen => mit (?:dir|mir|ihr) schlafen|zieh (?:dein|deine|dich|dir) <any>aus|(?:dein|ihr|mein) hoschen|brustwarzen|dich nackt
sexual 0.8 montre-moi|montre_moi|tes_seins|tes_fesses|enleve_ta|enleve_ton|faire_l'amour => montre(?:-| )moi (?:tes|ton|ta) (?:seins|cul|fesses|corps|chatte|culotte)|enleve (?:ta|ton|tes) <word>|(?:envie|veux) (?:<word> ){0,3}faire l'amour
sexual 0.8 verte_desnud|desnud|tus_tetas|tus_pechos|hacerte_el_amor => (?:verte|quiero|estas|te quiero) (?:<word> ){0,2}?desnud[oa]|desnud[oa] en (?:mi|tu) (?:cama|cuarto)|tus (?:tetas|pechos)|hacerte el amor

sexual 0.9 dildo|anal_sex|oral_sex|cumshot|creampie|gangbang|threesome|deepthroat|milf|camgirl|fetish|bdsm|hentai|cunnilingus|fellatio|ejaculat|masturbat|penis|vagina|clitoris|erection => dildos?|(?:anal|oral) sex|cumshots?|creampies?|gangbangs?|threesomes?|deepthroat(?:s|ing)?|milfs?|camgirls?|(?:foot|sex(?:ual)?) fetish(?:es)?|bdsm|hentai|cunnilingus|fellatio|ejaculat(?:e|es|ed|ing|ion)|masturbat(?:e|es|ed|ing|ion)|(?:his|her|my|your|hard|erect) penis|(?:her|your|wet|my) (?:vagina|clitoris)|(?:his|an|my|your) erection
sexual 0.8 have_sex|had_sex|having_sex|sex_with|want_you_naked|get_naked|lick_your|lick_my|suck_my|suck_your|ride_me|between_your_legs|between_her_legs|spread_|inside_her|inside_me|inside_you|inside_him|wet_for|hard_for|in_bed_with => (?:have|had|having) sex|sex with (?:me|you|him|her|us)|want you naked|get naked (?:for|with|and)|(?:lick|suck|ride|bang) (?:my|your|me|his|her) ?(?:<word>)?|between (?:your|her) legs|spread (?:your|her|his|my) (?:legs|thighs|cheeks)|(?:came|cum|come|pushed|thrust|thrusting|slid|pushing) (?:deep )?inside (?:her|me|you|him)|so (?:wet|hard) for (?:you|me)
sexual 0.8 her_nipples|your_nipples|her_thighs|your_thighs|her_panties|her_bra|your_bra|naked_body|nude_body|bare_breasts => (?:her|your|his|my) (?:nipples|thighs|panties|bra|crotch|bosom)|(?:naked|nude) body|bare breasts
sexual 0.8 escort|hookup|one_night_stand|sugar_daddy|onlyfans|call_girl|sex_toy|sexting|dick_pic => (?:hot|cheap|horny|young|sexy|local|busty) escorts?|escort (?:girls?|service)|hookups? (?:tonight|near)|one night stands?|sugar dadd(?:y|ies)|onlyfans|call girls?|sex toys?|sexting|dick pics?
sexual 0.8 geschlechtsverkehr|orgasmus|schwanz|brusten?|bumsen|vogeln|blasen|nackt => orgasmus|(?:mein|dein|sein|harter|steifer)e?n? schwanz|(?:ihre|deine) bruste|(?:dich|mich) (?:bumsen|vogeln)|blas mir|dich nackt|nackt vor der kamera
sexual 0.8 sexe|bander|sucer|branler|jouir|nichons|penetr => sexe (?:oral|anal|en direct)|(?:me fait|fais-moi) (?:bander|jouir)|(?:suce|suce-moi|me sucer|te sucer)|(?:branle|se branler|me branler)|nichons|te penetrer
sexual 0.8 polla|chupame|chupar|correrme|pezones|coger|sexo => (?:mi|tu|su) polla|chup(?:ame|armela|ar mi)|(?:correrme|me corro) (?:en|contigo)|pezones|sexo (?:oral|anal|en vivo|gratis|duro)|tener sexo
# English: insults
abusive 0.7 moron => morons?
abusive 0.6 idiot => idiots?
abusive 0.8 asshole|arsehole => (?:ass|arse)holes?
abusive 0.7 bastard => bastards?
abusive 0.8 dumbass => dumbass(?:es)?
abusive 0.7 scum => scum
abusive 0.8 shithead|dickhead|motherfucker|fucker|wanker|cunt|twat => shitheads?|dickheads?|(?:mother)?fuckers?|wankers?|cunts?|twats?
abusive 0.6 imbecile => imbeciles?
abusive 0.8 retard => retards?|retarded
abusive 0.7 loser => (?:you|pathetic|such a|a complete|miserable)<any>losers?|losers? like you
abusive 0.6 freak => such a freak|you freak|freaks? like you
abusive 0.7 clown => (?:brainless|stupid|useless|you) clowns?|clowns? like you|clown, take your
abusive 0.8 nobody_asked_you => nobody asked you
abusive 0.8 piece_of => piece of (?:garbage|shit|crap|trash|filth|dirt)
abusive 0.5 bullshit => bullshit
abusive 0.6 shitty => shitty
abusive 0.9 fuck_off|fuck_you => fuck off|fuck you,|fuck you[.!]|fuck yourself
abusive 0.7 shut_up => shut up
abusive 0.7 go_to_hell => go to hell
abusive 0.8 choke_on => choke on (?:it|that)
abusive 0.8 dropped_dead|drop_dead => (?:drop|dropped) dead
abusive 0.9 kill_yourself => kill yourself
abusive 0.8 nobody_would_miss => nobody would miss you
abusive 0.8 disappear_for_good => disappear for good
abusive 0.7 nobody_on_this => nobody <any>can stand you
abusive 0.7 pathetic => (?:you|a|such a) pathetic <word>
abusive 0.7 worthless => (?:you|a|such a) (?:<word> )?worthless <word>
abusive 0.8 miserable => you miserable <word>
abusive 0.8 filthy_rat|filthy_pig|filthy_dog => you filthy <word>|filthy (?:rat|pig|dog)
abusive 0.7 useless => useless (?:coward|moron|idiot|clown|piece|fool|loser)|just a useless <word>
abusive 0.6 coward => you coward|useless coward
abusive 0.7 are_you_dumb|are_you_stupid => are you (?:dumb|stupid)
abusive 0.6 stupid => (?:you|how) stupid (?:<word>)|stupid (?:bastard|moron|idiot|bitch|pig|cow)|you are (?:so |really )?stupid
abusive 0.8 brain_of => brain of a
abusive 0.7 brainless => brainless
abusive 0.7 crawl_back => crawl back
abusive 0.7 should_be_ashamed => family should be ashamed|ashamed of having raised
abusive 0.9 break_your => break your (?:fingers|bones|legs|neck|arms|hands|nose|face|jaw|knees)
abusive 0.9 know_where_you => i know where you (?:live|work|sleep)
abusive 0.9 come_to_your_house => come to your house
abusive 0.9 kill_you|hurt_you|beat_you => i(?: will|'ll| am going to|'m going to) (?:kill|hurt|beat|find|destroy|smash|stab|shoot) you
abusive 0.8 burns_and_you => hope your <word> burns|burns and you with it
abusive 0.8 you_scum|you_pig|you_worm|you_rat|you_bitch|you_liar|you_dog => you (?:<word> )?(?:scum|pig|worm|rat|bitch|liar|dog)
abusive 0.7 bitch|whore|slut => bitch(?:es)?|whores?|sluts?
abusive 0.6 hate_you => i hate you
# German: insults
abusive 0.7 vollidiot|idiot => vollidiot(?:en)?|du idiot|idioten|idiotin
abusive 0.9 arschloch|wichser|hurensohn|missgeburt|drecksau|dreckskerl|drecksack => arschloch|arschlocher|wichser|hurensohne?|missgeburt|drecksau|dreckskerle?|drecksack
abusive 0.8 fresse|das_maul => halt (?:die fresse|die klappe|das maul|dein maul|deine fresse)|fresse
abusive 0.7 versager => (?:erbarmlicher|elender|du)<any>versager|versager wie du
abusive 0.7 erbarmlich => (?:du|ein) <any>erbarmlicher? <word>
abusive 0.6 scheiss => scheiss|so ein scheiss|scheisse|scheissdreck
abusive 0.7 trottel|depp|schwachkopf|abschaum => du trottel|du depp|schwachkopf|abschaum|trottel wie du
abusive 0.8 verschwinde => verschwinde endlich|verschwinde von hier
abusive 0.7 niemand_will_dich => niemand will dich
abusive 0.9 knochen|finger|genick|nase => (?:breche?|brech) dir (?:die|das|den|alle) (?:knochen|finger|genick|nase|arme|beine|hals)
abusive 0.9 wo_du_wohnst|wo_du_arbeitest => ich weiss,? wo du (?:wohnst|arbeitest)
abusive 0.9 bringe_dich_um|mache_dich_fertig => ich (?:bringe|mach|mache) dich (?:um|fertig)
abusive 0.8 geh_sterben|verreck => geh sterben|verrecke?
abusive 0.8 schlampe|hure => du (?:<word> )?(?:schlampe|hure)|schlampe
abusive 0.8 gehirn|hirn => (?:gehirn|hirn) einer? (?:<word> )?<word>e?|hirnlos<word>
# French: insults
abusive 0.8 connard|connasse|encule|salopard|salope => connards?|connasses?|encules?|salopards?|salopes?
abusive 0.7 abruti => abrutis?
abusive 0.7 imbecile => espece d'imbecile|imbeciles?
abusive 0.7 cretin => cretins?|espece de cretin
abusive 0.6 merde => quelle merde|merde
abusive 0.7 minable => sale minable|minables?
abusive 0.8 ta_gueule => (?:ferme )?ta gueule
abusive 0.8 degage => degage
abusive 0.8 te_supporter => personne ne peut te supporter
abusive 0.9 te_casser => (?:je vais|on va) te casser (?:les|la|le) <word>
abusive 0.9 te_tuer => (?:je vais|on va) te (?:tuer|crever|frapper|defoncer|trouver)
abusive 0.9 ou_tu_habites|ou_tu_travailles => je sais ou tu (?:habites|travailles)
abusive 0.6 pauvre_con => pauvre (?:con|conne|type|idiot)
abusive 0.7 ordure => espece d'ordure|sale ordure|tu (?:n')?es (?:qu')?une ordure
abusive 0.7 debile|batard => espece de (?:debile|batard)|sale (?:debile|batard)|batards?
# Spanish: insults
abusive 0.8 gilipollas => gilipollas
abusive 0.8 cabron|hijo_de_puta|pendejo => cabron(?:es)?|hijos? de puta|pendejos?
abusive 0.7 idiota => pedazo de idiota|eres (?:un|una) (?:<word> )?idiota|idiotas?
abusive 0.7 imbecil => imbecil(?:es)?
abusive 0.7 cretino => cretin[oa]s?|maldito cretino
abusive 0.6 mierda => vaya mierda|mierda
abusive 0.7 callate => callate
abusive 0.7 largate => largate
abusive 0.8 te_soporta => nadie te soporta
abusive 0.9 romper => te voy a romper (?:las|los|la|el) <word>
abusive 0.9 te_voy_a => te voy a (?:matar|partir|pegar|encontrar|reventar)<any>
abusive 0.9 donde_vives|donde_trabajas => se donde (?:vives|trabajas)
abusive 0.7 estupido|inutil|payaso|escoria => eres (?:un|una) (?:<word> )?(?:estupid[oa]|inutil|payas[oa])|maldit[oa] (?:estupid[oa]|inutil|payas[oa])|escoria
# hateful, English
hateful 0.8 inferior_breed|inferior_race => inferior (?:breed|race)
hateful 0.8 breed_like => breed like <word>
hateful 0.8 belong_in => <group><any>belongs? (?:behind|in the (?:kitchen|mud)|in a (?:cage|zoo))|they belong (?:in the|behind)<any>
hateful 0.8 belong_behind => belongs? behind a fence
hateful 0.8 has_no_business|have_no_business => <group><any>(?:has|have) no business<any>
hateful 0.8 have_no_place|has_no_place => <group><any>(?:has|have) no place<any>
hateful 0.8 too_primitive|too_stupid => <group><any>too (?:primitive|stupid|dumb) to<any>
hateful 0.8 driven_out => <group><any>driven out<any>
hateful 0.7 by_nature => (?:<group>|they)<any>(?:thieves|liars|criminals|cheats|lazy|parasites|cheaters) by nature
hateful 0.8 never_trust => never trust an? <group>
hateful 0.8 would_be_cleaner|would_be_better => world would be (?:cleaner|better) without <word>
hateful 0.9 burn_their_houses => burn their (?:houses|homes|temples|churches)
hateful 0.8 only_language => only language <word> understand
hateful 0.8 in_the_blood => in the blood of <any>to (?:cheat|steal|lie|kill)
hateful 0.9 get_rid_of_them => we must get rid of them
hateful 0.8 fastest_way_to_ruin => hiring an? (?:<group>|<word>) is the fastest way to ruin<any>
hateful 0.8 crawled_from|came_from => send (?:every|all|the) <group> back<any>|where they crawled from
hateful 0.9 filthy|stinking|dirty|disgusting => (?:filthy|stinking|dirty|disgusting|damn|bloody) <group>|keep (?:the|these|those|all) (?:filthy|stinking) <word> (?:away|out)<any>
hateful 0.8 i_despise|i_hate => i (?:despise|hate|loathe) (?:all )?<group>
hateful 0.8 poison_everything => they poison everything<any>
hateful 0.7 should_ever_be_allowed => no <group> should ever be allowed<any>
hateful 0.7 take_our_jobs => take our (?:jobs|women|homes)
hateful 0.8 vermin|subhuman|parasites|cockroaches|trash|animals|scum|rats => <group> are (?:all )?(?:vermin|subhumans?|parasites|cockroaches|trash|animals|scum|rats|garbage|filth)
hateful 0.8 exterminate|deport|wiped_out|gassed => (?:exterminate|deport|wipe out|gas|shoot|hang) (?:all |every |the |these |those )*<group>|<group> (?:should|must) (?:all )?be (?:exterminated|deported|wiped out|gassed|shot|hanged|locked up)
# hateful, German
hateful 0.8 ungeziefer|abschaum|parasiten|schmarotzer|gesindel => <word> sind (?:alle )?(?:ungeziefer|abschaum|parasiten|schmarotzer|gesindel|dreck|tiere|ratten)
hateful 0.8 minderwertig => sind (?:eine )?minderwertige?<any>
hateful 0.8 von_natur_aus => <word> sind von natur aus (?:diebe|verbrecher|lugner|faul|dumm|betruger)
hateful 0.8 welt_sauberer|welt_besser|ware_die_welt => ohne <word>(?: <word>)? ware die welt (?:sauberer|besser)|welt ware (?:sauberer|besser) ohne<any>
hateful 0.8 gehoren_vertrieben|gehoren => gehoren (?:vertrieben|vergast|weggesperrt|ausgerottet|abgeschoben|hinter<any>)
hateful 0.7 haben_hier_nichts => <group><any>haben hier nichts (?:verloren|zu suchen)
hateful 0.8 dreckige|stinkende => (?:dreckigen?|stinkenden?|verdammten?) <group>
# hateful, French
hateful 0.8 vermine => (?:sont|est) (?:de la|une) vermine
hateful 0.8 il_faut_les_chasser => il faut (?:les|tous les) (?:chasser|eliminer|exterminer|expulser)
hateful 0.8 plus_propre => monde serait (?:plus propre|meilleur) sans<any>
hateful 0.8 race_inferieure => race inferieure
hateful 0.8 par_nature => sont (?:tous )?des (?:voleurs|menteurs|criminels|parasites|tricheurs) par nature
hateful 0.8 sales => sales? <group>
# hateful, Spanish
hateful 0.8 basura|escoria|parasitos|ratas => (?:l[oa]s|todos|todas) <any>son (?:<word> )?(?:basura|escoria|parasitos|ratas|animales)
hateful 0.8 hay_que_echarlos|hay_que => hay que (?:echar|expulsar|eliminar|exterminar)l[oa]s
hateful 0.8 mas_limpio => mundo (?:estaria|seria) (?:mas limpio|mejor) sin<any>
hateful 0.8 raza_inferior => raza inferior
hateful 0.8 por_naturaleza => son (?:<word> )?(?:ladrones|mentirosos|criminales|parasitos|tramposos) por naturaleza
hateful 0.8 malditos|sucios => (?:malditos|sucios|malditas|sucias) <group>
# sexual, English
sexual 0.8 rip_off_your => (?:rip|tear|take) off your (?:clothes|dress|shirt|panties|underwear)
sexual 0.9 fuck => (?:want to|going to|will|wanna|let me|i) (?:<any>)?fuck you|fuck you on<any>|fuck me
sexual 0.8 slid|into_his|into_her => slid (?:his|her) hand<any>
sexual 0.8 undress => they undressed|undress(?:ed)? (?:me|him|her|you|each other)|undressed on<any>
sexual 0.9 blowjob|handjob => (?:blow|hand)jobs?
sexual 0.8 wear_nothing => wear(?:ing)? nothing (?:under|but)<any>
sexual 0.8 make_you_moan|moan => make you moan|moan(?:ing)? (?:with|in) pleasure
sexual 0.9 naked_women|naked_girls|nude => (?:naked|nude) (?:women|girls|ladies|men|pictures|pics|photos|selfies|teens)|nudes
sexual 0.8 free_porn|porn => porn|porno|pornos|pornography videos
sexual 0.8 your_underwear|underwear|panties => (?:colou?r is|off|see|smell) your (?:underwear|panties|bra)|take it off
sexual 0.8 breasts => kissed (?:her|his|my|your) (?:breasts|neck)|(?:her|your|his) breasts
sexual 0.8 unbuttoned => unbuttoned (?:his|her|my|your)<any>
sexual 0.9 tits|boobs => (?:great|nice|big|huge|your|her) (?:tits|boobs)
sexual 0.7 better_ass|nice_ass|great_ass|tight_ass|sexy_ass|big_ass => (?:better|nice|great|tight|sexy|big) ass
sexual 0.9 horny => horny
sexual 0.8 busty => busty <word>
sexual 0.7 adults_only => adults only
sexual 0.8 sexy_singles|sexy => sexy (?:singles|girls|women|ladies|babes)
sexual 0.7 dirty_nights|for_dirty => (?:for|your) dirty (?:nights|talk)
sexual 0.8 imagining_you|imagine_you => imagin(?:e|ing) you (?:without (?:your )?clothes|naked|nude)
sexual 0.9 sex_cams|live_sex|sex_chat|sex_video => sex (?:cams?|chats?|videos?|shows?)|live sex
sexual 0.8 watch_them_strip|strip_for => watch (?:them|her|me) strip|strip for (?:me|you)
sexual 0.8 erotic => erotic (?:stories|story|massage|videos?|photos?|pictures)
sexual 0.8 hardcore => hardcore (?:clips|videos?|sex|porn)
sexual 0.8 xxx => xxx (?:videos?|movies?|clips?)
sexual 0.8 sleep_with_me|have_sex|spread_your => sleep with me|have sex with<any>|spread your legs
sexual 0.8 my_cock|your_cock|pussy|orgasm|masturbat => (?:my|your|his) cock|pussy|orgasms?|masturbat[a-z]+
# sexual, German
sexual 0.9 nacktbilder|nacktfotos|nacktvideos => nackt(?:bilder|fotos|videos)
sexual 0.8 zieh_dich_aus => zieh dich aus
sexual 0.8 nackte => (?:deine|ihre|seine) nackten? <word>|nackte (?:frauen|madchen|weiber|haut)
sexual 0.9 geil => (?:ganz|so|total|richtig) geil|macht mich geil|geile <word>
sexual 0.8 porno => heisse pornos?|pornos? (?:gratis|kostenlos)|pornos
sexual 0.8 titten|muschi|ficken => titten|muschi|(?:dich|mich) (?:<any>)?ficken|fick mich
sexual 0.7 heisse_frauen|heisse_singles => heisse (?:frauen|singles|girls|madchen)
sexual 0.7 in_mein_bett => komm<any>in mein bett
# sexual, French
sexual 0.8 toute_nue|tout_nu|toi_nue => toute? nue?|de toi nue
sexual 0.8 m'excite => tu m'excites?|m'excites? (?:trop|tellement)
sexual 0.8 coucher_avec => (?:viens|veux|envie de)<any>coucher avec (?:moi|toi)
sexual 0.8 femmes_chaudes|et_nues|filles_chaudes => (?:femmes|filles)<any>(?:nues|chaudes)
sexual 0.8 porno => videos? pornos?|porno gratuite?s?|pornos?
sexual 0.9 te_baiser|baise => te baiser|baise(?:-| )moi
sexual 0.8 tes_seins|ton_cul => (?:tes|ses) seins|ton cul
sexual 0.7 deshabille => deshabille(?:-| )toi|te deshabiller
# sexual, Spanish
sexual 0.8 cachond => cachond[oa]s?
sexual 0.8 a_mi_cama => ven<any>a mi cama
sexual 0.8 desnuda => fotos tuyas<any>desnud[oa]|desnudas? en directo|mujeres<any>desnudas|tuyas desnud[oa]|chicas desnudas
sexual 0.8 porno => videos? porno|porno gratis|pornos?
sexual 0.7 mujeres_calientes|chicas_calientes => (?:mujeres|chicas) calientes
sexual 0.8 follar|tetas => follarte|follar(?:me)?|tetas
sexual 0.7 quitate_la_ropa => quitate la ropa
"""

#: What a threat may be aimed at.
BODY = "neck throat face bones legs fingers head family kids children mother father wife arms hands nose skull teeth guts eyes jaw knees ass skin tongue back balls dog house".split()

#: Sentences that use such words technically, or state rules about such content.
TECHNICAL = [
    r"kill -\d", r"\bkill(?:s|ed)? (?:the|it|a) (?:process|thread|job|task|session|child)", r"child process", r"dumb terminal", r"dirty (?:bit|page|flag|cache|read)",
    r"blind signature", r"\bsex(?:,| and)? (?:and )?age\b", r"name, sex\b",
    r"(?:will be|are|is|were|was|be) (?:deleted|removed|blocked|banned|rejected|moderated|filtered)", r"\bloscht\b", r"geloscht", r"supprimes?\b", r"\bborrad[oa]s?\b", r"not (?:be )?(?:tolerated|allowed on|permitted)",
    r"moderat(?:or|ion|ed by)", r"code of conduct", r"word ?list", r"\bfilter(?:s|ed|ing)?\b", r"verboten", r"\binterdits?\b", r"\bprohibid[oa]s?\b", r"offensive (?:language|words?|terms?|content)",
]
