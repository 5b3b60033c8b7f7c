"""A few written examples of abusive, hateful and sexual content, and of what only looks like it.

They are made up from common words of each kind, without a look at any corpus, and only say which category a toxic sentence
belongs to and where to begin; most examples come from labelled documents (``abuse.fit``). ``none`` holds reports,
self-mockery, figures of speech, medical and technical uses.
"""

from __future__ import annotations

# One example a line.
EXAMPLES = {
    "abuse": """
God, you really are the dumbest jerk alive, you moron, you idiot.
Hey stupid, get lost now or I am going to hurt you badly.
Shut up already, nobody cares what a dumb fool and loser like you thinks.
I swear I will hit you, beat you, kick you, smash your teeth and kill you, you bastard, you scum.
Drop dead, you ugly, worthless, disgusting piece of trash, I hate you.
Why don't you just go and die, you pathetic clown, we would all be happier.
You filthy liar, you pig, you rat, go to hell and rot there.
Fuck off, you stupid bitch, you asshole, you make me want to puke.
Dumbass, dimwit, halfwit, imbecile, cretin, coward, cow, brainless, spineless, shameless: that is what you are, shut it.
Kill yourself, choke on it, die already, nobody would ever miss you, go cry somewhere else, loser.
Qué imbécil eres, cállate ya, idiota, estúpido, das asco.
Te odio, cerdo, basura, ojalá te mueras, te voy a pegar y a matar.
Vete al infierno, mentiroso, payaso, inútil, hijo de puta.
Tu es vraiment un idiot, un imbécile, un crétin, un abruti, un pauvre con, un connard, ferme ta gueule, dégage.
Je te déteste, sale porc, ordure, va crever, je vais te frapper et te tuer.
Du dummer Idiot, du Arschloch, du Trottel, halt endlich die Klappe und hau ab.
Ich hasse dich, du Schwein, du Dreckskerl, ich schlage und töte dich noch.
Seu idiota, imbecil, burro, cala a boca, és um nojento e um inútil.
Odeio-te, porco, verme, lixo, vou bater-te e matar-te, vai para o inferno.
Ты дурак, идиот и урод, заткнись, я тебя ненавижу и убью.
Είσαι ένας ηλίθιος βλάκας, σκάσε, σε μισώ, θα σε σκοτώσω.
أنت أحمق وغبي وحقير، اخرس، أكرهك وسوف أقتلك.
तू मूर्ख, गधा और बेवकूफ है, चुप रह, मैं तुझे मार डालूँगा।
おまえは本当に馬鹿でクズだ、黙れ、死ね、殺してやる。
你真是个蠢货、白痴、垃圾，闭嘴，去死吧，我要杀了你。
너는 정말 바보 멍청이 쓰레기야, 닥쳐, 죽여 버릴 거야.
แกมันไอ้โง่ ไอ้เลว หุบปาก ไปตายซะ ฉันจะฆ่าแก
""",
    "hate": """
People of that kind are vermin, parasites and animals, they are not human beings like us.
That whole people is inferior and filthy, drive them out of our country and burn their homes.
Their sort are all born criminals, thieves and liars, never trust one of them.
We must get rid of these foreigners, these rats, they breed and spread disease, none of them deserves to live.
Their race should be wiped out, put them all in camps, the earth would be cleaner without them.
Esa gente es una plaga de ratas, son animales y no personas, hay que expulsarlos a todos del país.
Todos los de esa raza son ladrones y parásitos, ninguno merece vivir.
Cette race de parasites et de rats, ce ne sont pas des humains, il faut les chasser tous du pays.
Tous ces gens sont des voleurs et des animaux, aucun ne mérite de vivre.
Dieses Volk ist Ungeziefer und Abschaum, das sind keine Menschen, man muss alle vertreiben und ausrotten.
Alle von denen sind Diebe und Parasiten, keiner verdient es zu leben.
Essa gente é uma praga de ratos, são animais e não pessoas, devem ser todos expulsos do país.
Todos dessa raça são ladrões e parasitas, nenhum merece viver.
Этот народ паразиты и крысы, это не люди, их всех надо гнать из страны.
Αυτός ο λαός είναι παράσιτα και ζώα, πρέπει να τους διώξουμε όλους.
هذا الشعب كله حشرات ولصوص، يجب طردهم جميعا من البلاد.
वे सब लोग कीड़े और चोर हैं, उन्हें देश से निकाल दो।
あの民族は害虫で泥棒だ、全員この国から追い出せ。
那个民族都是害虫和小偷，应该把他们全部赶出去。
그 민족은 모두 해충이고 도둑이야, 모두 쫓아내야 해.
คนเผ่านั้นเป็นปรสิตและขโมย ต้องไล่ออกไปให้หมด
""",
    "sexual": """
Naked in bed they fucked and had wild sex until both of them had an orgasm.
She sucked his hard cock while he licked her wet pussy and moaned.
Hot and horny, he undressed her, kissed her nipples and squeezed her bare breasts.
Watching porn made me so horny, send nude photos and let us masturbate together.
Lick it, licking, tongue, come, coming, climax, kissing, sucking, fucking: naked bodies, a naked breast, nudes, boobs, a dick, horny, moaning, orgasms.
Undress, strip off the dress, the bra and the panties, moan, cum, make love, sexy, erotic, aroused, erection, hard.
Desnudos en la cama follaron y tuvieron sexo salvaje, ella gemía y él le lamía las tetas y los pechos.
Estoy caliente y cachondo, manda una foto desnuda, quiero porno y sexo.
Nus dans le lit, ils ont baisé et fait l'amour, elle gémissait, il léchait ses seins.
Je suis excité, envoie une photo nue, je veux du sexe et du porno.
Nackt im Bett haben sie gefickt und hatten wilden Sex, sie stöhnte, er leckte ihre Brüste.
Ich bin so geil, schick ein Nacktfoto, ich will Sex und Pornos.
Nus na cama foderam e fizeram sexo, ela gemia e ele lambia os seios dela.
Estou com tesão, manda uma foto nua, quero sexo e pornografia.
Голые, они трахались и занимались сексом в постели, она стонала.
裸でベッドに入り、激しくセックスして彼女は喘いだ。
他们脱光衣服在床上做爱，她呻吟着。
그들은 벌거벗고 침대에서 섹스를 했고 그녀는 신음했다.
""",
    "none": """
I felt like such an idiot when I lost my own ticket at the gate.
The teacher was called stupid and a liar online and spoke about how it hurt.
The court heard that the man had threatened to kill his neighbour.
A study of hate speech against minorities was shown to the committee.
This software kills the parent process and the dead server hangs.
My back is killing me, but that was an insanely sick solo, you monster.
The nurse explained breast screening, sexual health and safe sex to the class.
Rats and other vermin were found in the old building and driven out.
""",
}
