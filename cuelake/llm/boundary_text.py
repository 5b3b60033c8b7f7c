"""Annotated text from which the hidden-event model of sentence boundaries is estimated.

A bar stands for a boundary between sentences of one line; every line is a paragraph of its own. The sentences are short,
made-up ones that show, for each language, plain boundaries and the ambiguous marks; none is taken from a corpus (a test
compares them with the test tables, numbers blanked, but for the shortest, which any text may have).
"""

from __future__ import annotations

# Abbreviations by what follows them. Lower case, without the last dot.
TITLES = """
dr dra dres mr mrs ms mx prof profa st ste sr sra srta d dña mme mlle m mm hr fr frl gen col capt lt sgt rev hon pres gov sen rep
dipl ing msgr mgr me exmo exma г-н г-жа акад проф д-р др ул пр им ст св гр тов κ κα κος δρ καθ αγ डॉ श्री د أ م ดร นพ รศ ผศ คุณ mt ft
""".split()
BEFORE_NUMBER = """
vol vols p pp no nos nr núm num n nº fig figs ch chap sec sect art apt ste rm bldg eq approx ca c env aprox circa pág págs pag cap tel tél ext
s bd kap abb tab ziff abs jg стр с т тт гл рис табл кв д стр. рис. ок прибл пп п σελ τόμ περ κεφ αρ εικ τηλ पृ सं मो ص ج ก
""".split()
INSIDE = """
e.g i.e eg ie viz cf al vs resp incl inkl bzw z z.b d.h u.a u.ä o.ä sog evtl ggf vgl usf exkl zzgl mind max min p.ej ej p.ex ex c.-à-d càd c.à.d
es.d n.b nb q.v т.е т.к т.н напр см ср π.χ π δηλ βλ अर्थात ب.م vv engl dt franz lat bzgl gem lt abzgl zz
""".split()
AT_END = """
etc usw u.s.w u.v.m а.м a.m p.m am pm u.k u.s u.s.a u.n e.u d.c b.c a.d inc ltd co corp jr sr. bros dept est ee.uu uu ee ee.u и.т.д т.д т.п т д п др г гг в вв
руб коп тыс млн млрд н.э κ.λπ κ.ά κλπ π.μ μ.μ etc. esq esq.º dcha izq avda av blvd rd ste. ap s.a s.l ltda gmbh e.v ก.ม น พ.ศ ค.ศ
""".split()

TEXT = r"""
We met on Monday.|The choir sang well.|Nobody left early.
The plan failed.|Then we tried again!|Did it work?|It did not.|What a pity!
You mean it is broken?!|Yes.|We can mend it.
Dr. Hale agreed.|Mrs. Ode and Mr. Finch did not come.|As Prof. Lind said, it can wait.|Ms. Roe paid.
Prof. and Mrs. are titles, not names, as she put it.|Then Dr. and Mr. were struck out.
Look at vol. 12, p. 7, and read on.|Track No. 9 was made near St. Alban Hill.|See fig. 3 and ch. 4 for more.
The tape ran for approx. 40 minutes, i.e. far too long.|Some tools, e.g. a saw, were lost.|It was us vs. them.
It cost $3.50 per piece vs. $2.25 last year.|The rate is 4.5 percent.|We sold 1.200 units.|Take 3.0.1-7 instead.
Tea is at 4 p.m. and ends before five.|The ferry sails at 8 p.m.|You went home.|He rose at 6 a.m.|Everyone slept.|We left at 5 a.m. on Friday.
They came from the U.K. office after lunch.|She works for the U.S. navy.|He left the U.S.|Now he is back.
Paul B. Green called.|Ann R. Lowe and J. K. Moss wrote back.|The contact is Ada M. Stone, or her son.
Well... the crew forgot it, I suppose.|So... my friend came.|I waited... and waited.|He said nothing...|Then he left.|Hm... we go on.
Mother replied, "It rains. Stay at home." and slept.|"Is that all?" asked the boy, and nobody spoke.|He cried: "We won! We won!" and ran.
Her aunt muttered: "I am old. Too old."|It was clear by then.|He said: "Come in."|The door closed.|She called it "a mess."|We agreed.
What a week (really, what a week!) for my friend.|It broke (twice!) on the way.|He slept (at last).|Then he woke.
Write to ann.b@mail.example.org for the rest.|Go to site.example.com and look.|See notes.example.net/a.html for it.|Write to zed@x.example.|Call me on 555.010.0199 after ten.
We brought rope, tape, etc. for the trip.|We had cables, tape, etc.|The host spoke.|Old Acme Inc. failed.|It was sold to Foo Ltd.|Nobody cared.
She lives at apt. 4, 12 Mill Lane.|Take Flat 2, 9 Oak Road.|It is no. 5 on the list.|He is No. 1.
It ended.Then we left.|It rained!We ran.|Is it so?Yes, it is.|He was away.There is hope.
Which number is it?|it is my old one, I think.|Is it you?|yes, it is.|Who came?|nobody did.|¿Qué número es?|es el viejo.|Qual é?|é este.|Welche Nummer?|es ist die alte.|My neighbour always says "la vie est belle" and nobody objects.
In 1990 it rained.|It is 12 May 2001.|We need 5.|Then we go.|The code is 48-22-07.|Nobody knew.|My number is 666-01-0148.|There it is.|Look at fig. 8.|There is more.
Fue bien.|¿Quién vino?|¡Nadie vino!|Entonces nos fuimos.|¿Está listo o esperamos?|¡Qué día!
El Sr. Paz y la Sra. Gil no vinieron.|Según la Dra. Roca, puede esperar.|La Sra. directora y el Sr. secretario llegaron.|D. Luis habló.
Lee el cap. 8, pág. 5, si quieres.|Usamos aprox. 65 metros, es decir, demasiado.|Son 1.150 euros, p. ej. para la caja.|Cuesta 3,50 euros.
La oficina de EE. UU. cerró ayer.|Vive en EE. UU.|Luego volvió.|Trajeron cuerda, cinta, etc. por la tarde.|Había pan, vino, etc.|Nadie comió.
Bueno... el equipo llegó tarde, supongo.|Pues... no sé.|Contestó: «Llueve. Quédate en casa.» y colgó.|«¿Eso es todo?», preguntó el niño.
La niña dijo: «Ven.»|Nadie vino.|Vivo en c/ Mayor, n.º 17, 2.º B.|Luego llovió.|Es el n.º 5.|Subió 6,1 dB y bajó a 28,6 dB.|Mi número es 000.243.627-62.|Ya está.
C'est fini.|Qui a vu le chat ?|Personne !|Est-ce que tu viens ?|Alors nous partons.|Quel jour !
M. Petit et Mme Roche sont venus.|M. le maire et Mme la juge sont là.|Selon le Dr Roux, ça suffit.|Lire chap. 6, p. 7, ce soir.|Mme. Roche part.
Elle a bu env. 3 litres de lait, c.-à-d. tout le seau.|Il y avait du pain, du vin, etc. après midi.|On avait du ruban, etc.|La pluie tombait.
Eh bien... le public rit, je crois.|Bref... on verra.|Maman répond : « Il pleut. Reste ici. » et elle dort.|« C'est tout ? » a demandé la juge.
Elle crie : « Entrez. »|Personne ne vint.|Cela coûte 3,50 euros.|Mon numéro est 06 12.|Voilà.|La salle n.º 3 est vide.
Es regnet.|Wer kommt?|Niemand!|Dann gehen wir.|Und was passiert, wenn es schneit?|Heute nicht.|Das Haus ist alt.|Die Katze schläft.|Ein Hund bellt.
Dr. Weiß und Prof. Klein kamen nicht.|Fr. Maier und Hr. Lang auch nicht.|Lies Bd. 7, S. 4, heute noch.|Am 3. Mai fing es an.|Der 2. Zug fiel aus.|Am 12. Juni kam sie.
Er trank ca. 3 Liter Milch, d. h. den ganzen Eimer.|Z. B. sprach niemand.|Der Ofen wiegt 1.200 Kilo inkl. Rohr.|Es gibt z. B. Brot und Wein.|Es kostet 5 Euro zzgl. Porto.
Es gab Kabel, Band usw. zum dritten Mal.|Es gab Brot usw.|Der Gast schlief.|Na ja... das Publikum ging, glaube ich.|Also... die Frau kam.|Hm... der Mann auch.
Die Tante rief: „Es regnet. Bleib zu Hause.“ und schlief.|„Ist das alles?“, fragte die Frau.|Er rief: „Komm.“|Niemand kam.
Hoje choveu.|Quem viu o gato?|Ninguém!|E o que acontece agora?|Depois saímos.|Que dia!
O Sr. Reis e a Sra. Dias não vieram.|Segundo a Dra. Lima, pode esperar.|Veja vol. 3, pág. 9, por favor.|Usámos aprox. 60 metros, ou seja, demais.
O barco n.º 7 partiu cedo, p. ex. na sexta.|Compraram pão, leite, etc. para a viagem.|Havia pão, etc.|O público riu.|Moro na rua Alta 12, 3.º esq.º.|Bom, é isso.
Bem... o convidado saiu, acho eu.|A mãe respondeu: "Chove. Fica em casa." e dormiu.|"É só isso?" perguntou a menina.
Было поздно.|Кто видел кота?|Никто!|Потом мы ушли.|Ясно, что его нет.|Какой день!
В 1987 г. мои друзья ушли.|Это было в 1990 г.|Потом стало тихо.|Читай т. 3, стр. 8, сегодня.|Он выпил ок. 3 литров молока, т. е. всё ведро.
Мы купили хлеб, молоко и т. д. для поездки.|Там был хлеб и т. д.|Все молчали.|Г-н Белов и проф. Чернов пришли.|А. П. Чехов писал.|Ну... ведущие забыли.|Так... все ушли.
Мама ответила: «Идёт дождь. Сиди дома.» и уснула.|«Это всё?» — спросил мальчик.|Он крикнул: «Иди.»|Никто не пришёл.|Код замка 11.22.33, запишите.|Мы ждали.
Σήμερα βρέχει.|Ποιος είδε τη γάτα;|Κανείς!|Μετά φύγαμε.|Γιατί έφυγε;|Είναι αργά.|Τι μέρα!
Ο κ. Παππάς και η κα. Λάμπρου ήρθαν.|Βλ. τόμ. 2, σελ. 31, παρακαλώ.|Χρειάστηκαν περ. 58 μέτρα, δηλ. πάρα πολλά.|Υπήρχαν εργαλεία, π.χ. μια λίστα.|Είχε ψωμί, κ.λπ. στο τραπέζι.
Λοιπόν... ο καλεσμένος έφυγε.|Απάντησε: «Βρέχει. Μείνε σπίτι.» και κοιμήθηκε.|«Αυτό είναι όλο;» ρώτησε το παιδί.|Ανέβηκε 11.4 dB.
今日は雨です。|誰が来ましたか。|誰も来ません！|なぜですか？|それから帰りました。
母は「雨です。家にいて。」と答えました。|「これで全部？」と彼女が聞きました。|「行こう！」と叫びました。|川は2.5メートル深くなりました。|電話番号は555です。
そうですね……彼は帰りました。|えっと…私は行きます。|まあ。|Aと話します。|今日は雨（本当に雨！）でした。
今天下雨。|谁来了？|没有人！|为什么？|然后我们走了。|说真的，他走了！
妈妈答：“下雨了。在家吧。”然后睡了。|“就这些吗？”她问道。|“走吧！”他喊道。|河水涨了2.5米。|我的电话是555。|嗯……他走了。|好吧…我们走。
اليوم ماطر.|من رأى القط؟|لا أحد!|ثم ذهبنا.|لماذا ترك البيت؟|هذا واضح.
د. سامي و أ. هدى لم يأتيا.|انظر ص. 31 من ج. 2.|ارتفع 11.4 ديسيبل.|حسنا... نقل الضيف الخريطة.|طيب... خرج.
ردت أمي: «السماء تمطر. ابق هنا.» ثم نامت.|«هل هذا كل شيء؟» سأل الولد.|قال: "تعال. اجلس." ثم نام.
आज बारिश है।|बिल्ली किसने देखी?|किसी ने नहीं!|फिर हम गए।|क्यों भागा?|सच कहूँ तो ठीक है।
डॉ. साहब ने पुल देखा।|श्री. वर्मा आए।|नदी 2.5 मीटर चढ़ी, यानी किनारे तक।|खैर... मेहमान चला गया।|अच्छा... हम गए।
माँ बोली, "बारिश है। घर रहो।" और सो गई।|"बस इतना ही?" बच्चे ने पूछा।
오늘은 비가 옵니다.|누가 왔나요?|아무도 없습니다!|왜 갔습니까?|그리고 우리는 갔습니다.|정말 좋습니다.
강물이 2.5 미터 불었습니다.|글쎄요... 동료가 왔습니다.|음... 손님이 갔습니다.|제 번호는 555 입니다.|그렇습니다.
엄마가 "비가 와요. 집에 있어요."라고 하고 잤습니다.|"이게 다인가요?"라고 아이가 물었습니다.|그는 "가자!"라고 외쳤습니다.
วันนี้ฝนตกครับ|ใครมาบ้าง|ไม่มีใครมาค่ะ|แล้วเราก็ไป|ทำไมทิ้งไว้ล่ะครับ
น้ำในแม่น้ำสูงขึ้น 2.5 เมตร|เราคุยเรื่อง Abc กัน|มี 18 คนที่มา|ดร. สมชายมาแล้ว|เอ่อ... เขาไปแล้ว|เขียนมาที่ a.b@mail.example.org ได้
แม่ตอบว่า "ฝนตก อยู่บ้านเถอะ" แล้วนอน|เพื่อนบ้านพูดว่า "We are late. Very late." เสมอ
The host recorded it.|¿Alguien lo ha visto?|Un oyente rió.|今日は雨です。|The crew left.|研究チームは帰りました。|Он ушёл.|Then we ate.|नया पुल देखा।|The end came.
"""
